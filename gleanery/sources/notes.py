"""Driver-side writing into a folder of notes: guarded paths, atomic replacement, versions, frontmatter, table merges."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import os
import re
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame

from gleanery.functions import markdown
from gleanery.plans.engine import EngineError

ROOT_ARTIFACTS = frozenset({"log", "GRAPH_REPORT"})


def contained(root: str, path: str) -> Path:
    """The real place of a path, strictly below root; out_of_root otherwise."""
    base = Path(root).resolve()
    full = Path(os.path.realpath(base / path))
    if full == base or base not in full.parents:
        raise EngineError("out_of_root", path)
    return full


def relative(root: str, path: str, note: bool = True) -> str:
    """A path below root with forward slashes, ending in .md if it names a note."""
    raw = path.replace("\\", "/")
    full = contained(root, raw if not raw.startswith("/") else os.path.relpath(raw, root))
    out = full.relative_to(Path(root).resolve()).as_posix()
    return out if not note or out.endswith(".md") else out + ".md"


def adopt_case(root: str, folder: str) -> str:
    """Each part of a typed folder in the spelling of an existing one that differs in case alone."""
    at, out = Path(root), []
    for part in folder.strip("/").split("/"):
        names = [p.name for p in at.iterdir() if p.is_dir()] if at.is_dir() else []
        part = part if part in names else next((n for n in sorted(names) if n.casefold() == part.casefold()), part)
        out.append(part)
        at = at / part
    return "/".join(out)


def is_artifact(path: str) -> bool:
    return "/" not in path and path.removesuffix(".md") in ROOT_ARTIFACTS


def is_source_leaf(path: str) -> bool:
    return path.startswith("sources/")


def is_inbox(path: str, inboxes: tuple[str, ...] = ("_inbox", "inbox")) -> bool:
    return path.split("/")[0] in inboxes and "/" in path


def version(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()[:12]


def write_bytes(path: Path, content: bytes) -> None:
    """Replace a file whole: a new file beside it, flushed, renamed; its mode stays and a link is followed."""
    path = Path(os.path.realpath(path))
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=".new-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        if path.exists():
            os.chmod(name, path.stat().st_mode & 0o7777)
        os.replace(name, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(name)
        raise


@contextlib.contextmanager
def lock(path: str, wait: bool = True) -> Iterator[bool]:
    """Whether this process is the one writer while the block runs."""
    with open(path, "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | (0 if wait else fcntl.LOCK_NB))
        except OSError:
            yield False
            return
        yield True


def structure(body: str) -> list[str]:
    """What a body leaves open: fences, math, highlights, link brackets; code counts only for its fences."""
    prose = markdown.without_code(body)
    found = {
        "unclosed code fence": body.count("```") % 2, "unbalanced $$ block": prose.count("$$") % 2,
        "unbalanced == highlight": prose.count("==") % 2, "unbalanced [[wikilink]]": prose.count("[[") - prose.count("]]")}
    return [name for name, odd in found.items() if odd]


def lint(root: str, text: str) -> list[dict]:
    """Structural issues of a note, and its note links that no note of the folder answers: by base name, or by path with or without ending."""
    names = set()
    for p in Path(root).rglob("*.md"):
        rel = p.relative_to(root).as_posix()
        names |= {p.stem.casefold(), rel.casefold(), rel[:-3].casefold()}
    found = [{"kind": "structure", "target": x, "line": 0} for x in structure(text)]
    for m in re.finditer(r"\[\[([^\[\]|#^\n]+)", text):
        if m[1].strip().casefold() not in names:
            found.append({"kind": "unresolved_link", "target": m[1].strip(), "line": text.count("\n", 0, m.start()) + 1})
    return found


def write_note(root: str, path: str, body: str, props: dict | None = None, expect_version: str | None = None, create_only: bool = False) -> dict:
    """Write one note and tell its path, its new version, whether it is new, and what is wrong with it."""
    rel = relative(root, path)
    full = contained(root, rel)
    exists = full.exists()
    if exists and create_only:
        raise EngineError("bad_argument", f"{rel} exists")
    if exists and expect_version and expect_version != version(full.read_text("utf-8", "replace")):
        raise EngineError("changed", rel)
    if expect_version and not exists:
        raise EngineError("not_found", rel)
    if "\n" not in body and "\\n" in body:  # line ends came as backslash and letter
        for written, meant in (("\\r\\n", "\n"), ("\\n", "\n"), ("\\t", "\t")):
            body = body.replace(written, meant)
    text = with_props(body, props) if props else body
    write_bytes(full, text.encode())
    return {"path": rel, "version": version(text), "created": not exists, "lint": lint(root, text)}


def with_props(text: str, props: dict) -> str:
    """A note with frontmatter values set; None takes one away."""
    data, raw, body = markdown.frontmatter(text)
    if raw is not None and data is None:
        raise EngineError("bad_argument", "the frontmatter can't be read")
    merged = {k: v for k, v in {**(data or {}), **props}.items() if v is not None}
    if not merged:
        return body
    try:
        import yaml

        block = yaml.safe_dump(merged, allow_unicode=True, sort_keys=False)
    except ImportError:
        block = "".join(f"{k}: {v}\n" for k, v in merged.items())
    return f"---\n{block}---\n{body}"


def add_alias(text: str, alias: str) -> str:
    known = markdown.aliases(text)
    return text if alias in known else with_props(text, {"aliases": [*known, alias], "alias": None})


def append_note(root: str, path: str, more: str) -> dict:
    full = contained(root, relative(root, path))
    old = full.read_text("utf-8", "replace") if full.exists() else ""
    return write_note(root, path, old + ("" if not old or old.endswith("\n") else "\n") + more)


def delete_note(root: str, path: str) -> None:
    full = contained(root, relative(root, path))
    if not full.exists():
        raise EngineError("not_found", path)
    full.unlink()


def write_segments(root: str, name: str, text: str, source: str, sha256: str) -> list[str]:
    """A converted document as notes NN-slug.md with their provenance; apparatus is marked by its kind."""
    out = []
    for i, (kind, part) in enumerate(markdown.segments(text), 1):
        title = next((h[1] for h in markdown.headings(part)), name)
        slug = re.sub(r"[^\w]+", "-", title.lower()).strip("-")[:60] or "part"
        props = {"source": source, "text_sha256": sha256} | ({kind: True} if kind else {})
        out.append(write_note(root, f"{name}/{i:02d}-{slug}.md", part, props)["path"])
    return out


def merged(disk: DataFrame, mine: DataFrame, key: str) -> DataFrame:
    """What two writers know: the rows on disk but for the keys that this one has written, and its own."""
    return disk.join(mine.select(key).distinct(), key, "left_anti").unionByName(mine)
