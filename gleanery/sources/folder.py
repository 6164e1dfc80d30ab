"""Reading folders and files as tables, and converting documents to markdown."""

from __future__ import annotations

import hashlib
import io
import re
import subprocess
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import markdown
from gleanery.functions.arrow import generate
from gleanery.operators import files as listing


def scan(spark: SparkSession, root: str, patterns: Sequence[str] = (), content: bool = False) -> DataFrame:
    """path (below root), bytes, mtime, and content if asked, of all files that no rule ignores; content is pruned otherwise."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(base) + "/", "")
    columns = [path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")]
    rows = rows.select(*columns, *(["content"] if content else []))
    return rows.where(~listing.ignored(F.col("path"), patterns))


def texts(scanned: DataFrame) -> DataFrame:
    """path, mtime, text of the prose files of a scan with content; invalid bytes become replacement characters."""
    prose = scanned.where(listing.suffix(F.col("path")).isin(*listing.PROSE) & listing.is_text(F.col("content")))
    return prose.select("path", "mtime", F.decode("content", "UTF-8").alias("text"))


def indexable(scanned: DataFrame, code: Sequence[str] = ()) -> DataFrame:
    """Prose, PDFs without a markdown file of their name, and code up to 512 KiB."""
    kind = listing.suffix(F.col("path"))
    notes = scanned.where(kind == ".md").select(listing.stem(F.col("path")).alias("_stem"))
    pdfs = scanned.where(kind == ".pdf").join(notes, listing.stem(F.col("path")) == F.col("_stem"), "left_anti")
    other = scanned.where(kind.isin(*listing.PROSE) | (kind.isin(*code) & (F.col("bytes") <= listing.MAX_CODE_BYTES)))
    return other.unionByName(pdfs)


# Converters: content to markdown, by file ending. Further ones can be added to the table. -----------


def _plain(element: ElementTree.Element) -> str:
    return re.sub(r"\s+", " ", "".join(element.itertext())).strip()


def _epub(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
        tree = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in tree.iter() if e.tag.endswith("}item")}
        base = opf.rpartition("/")[0]
        spine = [items[e.get("idref")] for e in tree.iter() if e.tag.endswith("}itemref") and e.get("idref") in items]
        return "\n\n".join(markdown.html_to_markdown(z.read(f"{base}/{h}" if base else h).decode("utf-8", "replace")) for h in spine)


def _fb2(content: bytes) -> str:
    out = []
    for e in ElementTree.fromstring(content).iter():
        name = e.tag.rpartition("}")[2]
        if name == "title":
            out.append("## " + _plain(e))
        elif name == "p" and _plain(e):
            out.append(_plain(e))
    titles = {x[3:] for x in out if x.startswith("## ")}
    return "\n\n".join(x for x in out if x.startswith("## ") or x not in titles)


def _odf(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = ElementTree.fromstring(z.read("content.xml"))
    out = []
    for e in tree.iter():
        name = e.tag.rpartition("}")[2]
        if name == "h" and _plain(e):
            level = next((v for k, v in e.attrib.items() if k.endswith("outline-level")), "1")
            out.append("#" * min(6, int(level)) + " " + _plain(e))
        elif name == "p" and _plain(e):
            out.append(_plain(e))
        elif name == "table-row":
            out.append(" | ".join(_plain(c) for c in e if c.tag.endswith("table-cell")))
    return "\n\n".join(dict.fromkeys(out))


def _rtf(content: bytes) -> str:
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", "", content.decode("latin-1"))
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), re.sub(r"\\par[d]?\b ?", "\n\n", text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text)).strip()


CONVERTERS: dict[str, Callable[[bytes], str]] = {
    ".html": lambda b: markdown.html_to_markdown(b.decode("utf-8", "replace")), ".htm": lambda b: markdown.html_to_markdown(b.decode("utf-8", "replace")),
    ".vtt": lambda b: markdown.vtt_to_text(b.decode("utf-8", "replace")), ".epub": _epub, ".fb2": _fb2, ".odt": _odf, ".ods": _odf, ".odp": _odf, ".rtf": _rtf}


def pdf_layer(content: bytes) -> str:
    """The text layer of a PDF, pages parted by blank lines; needs a package that may be absent."""
    import pypdfium2

    pages = pypdfium2.PdfDocument(content)
    return "\n\n".join(p.get_textpage().get_text_range() for p in pages)


def convert(scanned: DataFrame, converters: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, markdown, reason: files of a scan with content, each by its ending; reason says why there is no markdown."""
    table = {".pdf": pdf_layer} | CONVERTERS | (converters or {})

    def one(path: str, content: bytes):
        found = next((f for k, f in table.items() if path.lower().endswith(k)), None)
        if found is None:
            return [(None, "no converter")]
        try:
            text = found(content or b"")
            return [(text, None if text.strip() else "no text")]
        except ImportError as e:
            return [(None, f"needs {e.name}")]
        except Exception as e:  # noqa: BLE001  a file that can't be read is a row with a reason
            return [(None, f"{type(e).__name__}: {e}"[:200])]

    rows = scanned.select("path", F.col("path").alias("_p"), "content")
    return generate(rows, ["path"], ["_p", "content"], one, [("markdown", "string"), ("reason", "string")])


def with_provenance(converted: DataFrame, originals: DataFrame) -> DataFrame:
    """path of the note, text with a frontmatter of source and text_sha256, source."""
    digest = originals.select(F.col("path").alias("source"), F.sha2("content", 256).alias("sha"))
    rows = converted.where("markdown IS NOT NULL").withColumnRenamed("path", "source").join(digest, "source")
    text = F.concat(F.lit("---\nsource: "), "source", F.lit("\ntext_sha256: "), "sha", F.lit("\n---\n\n"), "markdown")
    return rows.select(F.concat(listing.stem(F.col("source")), F.lit(".md")).alias("path"), text.alias("text"), "source", F.col("sha").alias("text_sha256"))


def identity(root: str) -> dict:
    """path, files, sha256 of a local folder: over the path and bytes of every file, folder by folder; hidden ones and links apart."""
    digest, n = hashlib.sha256(), 0
    for place, inner, found in Path(root).walk():
        inner[:] = sorted(x for x in inner if not x.startswith("."))
        for name in sorted(x for x in found if not x.startswith(".")):
            if not (file := place / name).is_symlink() and file.is_file():
                for part in (file.relative_to(root).as_posix().encode(), file.read_bytes()):
                    digest.update(part + b"\0")
                n += 1
    return {"path": str(root), "files": n, "sha256": digest.hexdigest()}


# Git ----------------------------------------------------------------------------------------------


def git(root: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, timeout=60, check=True).stdout


def git_files(spark: SparkSession, root: str) -> DataFrame:
    """path of tracked files and of new ones that no rule ignores."""
    paths = sorted(set(git(root, "ls-files", "-co", "--exclude-standard", "-z").split("\0")) - {""})
    return spark.createDataFrame([(p,) for p in paths], "path string")


def git_commits(spark: SparkSession, root: str) -> DataFrame:
    """sha, ts, path: the files that each commit touched."""
    rows, sha, ts = [], "", 0
    for line in git(root, "log", "--name-only", "--pretty=format:%x01%H %ct").split("\n"):
        if line.startswith("\x01"):
            sha, ts = line[1:].split()[0], int(line.split()[-1])
        elif line:
            rows.append((sha, ts, line))
    return spark.createDataFrame(rows, "sha string, ts long, path string")


def latest_commits(commits: DataFrame) -> DataFrame:
    """path, sha, ts of the newest commit of each file."""
    return commits.groupBy("path").agg(F.max_by(F.struct("sha", "ts"), F.struct("ts", "sha")).alias("c")).select("path", "c.sha", "c.ts")


def touched_since(commits: DataFrame, ts: int) -> DataFrame:
    return commits.where(F.col("ts") > ts).select("path").distinct()
