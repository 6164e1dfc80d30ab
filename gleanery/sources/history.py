"""What git knows of a folder: its root, its newest commit, what a commit held, what has changed since.

Every answer is null where git can't give one (no repository, an unknown commit, no git at all), which is not the same
as an empty answer.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable
from pathlib import Path

COMMIT = re.compile(r"[0-9a-f]{7,40}")


def ask(folder: str | Path, *arguments: str, given: str | None = None, fine: tuple[int, ...] = (0,)) -> str | None:
    """The output of a git command in a folder, null if it fails."""
    try:
        done = subprocess.run(["git", "-c", "core.quotepath=off", "-C", str(folder), *arguments], input=given, capture_output=True, text=True, errors="replace", timeout=60)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout if done.returncode in fine else None


def names(output: str | None) -> set[str] | None:
    return None if output is None else {x for x in output.split("\0") if x}


def repository(path: str | Path) -> Path | None:
    """The top folder of the repository that a file or folder lies in."""
    place = Path(path)
    top = (ask(place if place.is_dir() else place.parent, "rev-parse", "--show-toplevel") or "").strip()
    return Path(top).resolve() if top else None


def newest(root: str | Path) -> str | None:
    """The commit that is checked out."""
    found = (ask(root, "rev-parse", "--verify", "-q", "HEAD") or "").strip()
    return found or None


def ignored(root: str | Path, paths: Iterable[str]) -> set[str] | None:
    """Those of the paths that the repository's rules ignore."""
    given = "".join(f"{p}\0" for p in paths)
    return names(ask(root, "check-ignore", "-z", "--stdin", given=given, fine=(0, 1))) if given else set()


def commit_at(root: str | Path, day: str) -> str | None:
    """The newest commit up to the end of a day (YYYY-MM-DD), the first one for days before all."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", day or ""):
        return None
    before = (ask(root, "rev-list", "-n", "1", f"--before={day}T23:59:59", "HEAD") or "").split()
    return next(iter(before), None) or next(iter(reversed((ask(root, "rev-list", "--max-parents=0", "HEAD") or "").split())), None)


def content_at(root: str | Path, commit: str, path: str) -> str | None:
    """What a file held in a commit."""
    return ask(root, "show", f"{commit}:{path}") if COMMIT.fullmatch(commit or "") else None


def touched(root: str | Path, since: str, paths: Iterable[str]) -> set[str] | None:
    """Those of the paths that a commit after since has touched."""
    wanted = set(paths)
    if not COMMIT.fullmatch(since or ""):
        return None
    if not wanted:
        return set()
    found = names(ask(root, "log", "-z", "--format=", "--name-only", f"{since}..HEAD", "--", *sorted(wanted)))
    return None if found is None else {x.strip("\n") for x in found} & wanted


def changed(root: str | Path, since: str) -> set[str] | None:
    """Paths whose files differ from those of a commit, new ones that no rule ignores included."""
    differ = names(ask(root, "diff", "-z", "--name-only", since)) if COMMIT.fullmatch(since or "") else None
    new = names(ask(root, "ls-files", "-z", "--others", "--exclude-standard"))
    return None if differ is None or new is None else differ | new
