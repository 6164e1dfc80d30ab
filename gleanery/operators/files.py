"""The inventory of a folder: statuses, counts, pages of it, scopes, and reading parts of a text."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import code

STATUSES = ("indexed", "changed", "unconverted", "failed", "excluded")
# Suffixes of prose, of code beyond the language map, and folders that hold no work of one's own.
PROSE = (".md", ".txt", ".rst")
CODE_SUFFIXES = (".rs", ".go", ".rb", ".php", ".kt", ".swift", ".scala", ".sh", ".sql", ".cfg", ".ini", ".yaml", ".yml", ".toml", ".json")
NOISE_DIRS = ("node_modules", "vendor", "build", "dist", "target", "__pycache__", "site-packages", "coverage", "htmlcov")
# Files at the root that mark a source tree, and suffixes that count as prose there.
MARKERS = (
    "pyproject.toml", "setup.py", "package.json", "Cargo.toml", "go.mod", "CMakeLists.txt", "Makefile", "pom.xml", "build.gradle", "Gemfile",
    "composer.json", "mix.exs", "build.sbt", "Package.swift")
MARKED_PROSE = (".md", ".txt", ".docx", ".pdf")
#: What a converter here takes.
CONVERTIBLE = (".pdf", ".docx", ".epub", ".fb2", ".odt", ".ods", ".odp", ".rtf", ".xls", ".xlsx", ".pptx", ".html", ".htm", ".vtt")
MAX_CODE_BYTES = 512 * 1024


def code_suffixes() -> list[str]:
    """Suffixes of files that are read as code: those of the language map but for pages and styles, and the others."""
    return [*CODE_SUFFIXES, *(s for s in code.LANGUAGES if s not in (".html", ".css", *CODE_SUFFIXES))]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def in_folder(path: Column, folder: str | None) -> Column:
    """Whether a path is a folder or lies in it, without regard to case; everything does for no folder."""
    wanted = (folder or "").replace("\\", "/").strip("/").lower()
    wanted = wanted.removesuffix(".md")
    if not wanted:
        return F.lit(True)
    own = F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"\.md$", "")
    return (own == wanted) | F.startswith(own, F.lit(wanted + "/"))


def ignored(path: Column, patterns: Sequence[str] = (), noise: Sequence[str] = NOISE_DIRS) -> Column:
    """Whether a path is hidden, in a noise folder, or matches an ignore rule (bare names, name globs, root-relative globs)."""
    rules = [r"(^|/)\.[^/]", "(^|/)(" + "|".join(map(re.escape, noise)) + ")(/|$)"]
    for line in patterns:
        rule = line.split("#")[0].strip()
        if rule:
            body = re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(rule.strip("/")))
            rules.append(f"^(?s:{body})(/|$)" if "/" in rule else f"(^|/)(?s:{body.replace('.*', '[^/]*')})(/|$)")
    return path.rlike("|".join(f"(?:{r})" for r in rules))


def is_text(content: Column) -> Column:
    """Whether the first 4096 bytes hold no zero byte."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return ~F.contains(head, F.char(F.lit(0)))


def statuses(files: DataFrame, stamps: DataFrame, no_text: DataFrame, failures: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """files (path, mtime, bytes) with status and reason; the first rule that fits holds.

    stamps (path, mtime): what the index was built from. no_text (path, mtime, reason), failures (path, reason).
    """
    s = stamps.select("path", F.col("mtime").alias("s_mtime"))
    n = no_text.select("path", F.col("mtime").alias("n_mtime"), F.col("reason").alias("n_reason"))
    f = failures.select("path", F.col("reason").alias("f_reason"))
    kind = suffix(F.col("path"))
    sidecar = files.select(stem(F.col("path")).alias("_stem"), suffix(F.col("path")).alias("_kind")).where("_kind = '.md'").select("_stem").distinct()
    rows = files.withColumns({"_kind": kind, "_own_stem": stem(F.col("path"))}).join(s, "path", "left").join(n, "path", "left").join(f, "path", "left")
    rows = rows.join(sidecar.withColumn("_sidecar", F.lit(True)), F.col("_own_stem") == F.col("_stem"), "left")
    current = F.col("s_mtime").eqNullSafe(F.col("mtime")) & F.col("s_mtime").isNotNull()
    prose, conv = F.col("_kind").isin(*PROSE), F.col("_kind").isin(*CONVERTIBLE)
    is_code = F.col("_kind").isin(*suffixes) if suffixes else F.lit(False)
    state = F.when(current, "indexed").otherwise("changed")
    status = (
        F.when(F.col("f_reason").isNotNull(), "failed").when(prose, state)
        .when(conv & F.col("_sidecar"), "excluded").when(conv & (F.col("_kind") != ".pdf"), "unconverted")
        .when(conv & current, "indexed").when(conv & F.col("n_mtime").eqNullSafe(F.col("mtime")), "unconverted").when(conv, "changed")
        .when(is_code & (F.col("bytes") > MAX_CODE_BYTES), "excluded").when(is_code, state).otherwise("excluded"))
    reason = (
        F.when(F.col("f_reason").isNotNull(), F.col("f_reason")).when(prose, F.lit(None))
        .when(conv & F.col("_sidecar"), F.concat(F.lit("converted: "), F.col("_own_stem"), F.lit(".md")))
        .when(conv & (F.col("_kind") == ".pdf") & ~current, F.col("n_reason")).when(conv, F.lit(None))
        .when(is_code & (F.col("bytes") > MAX_CODE_BYTES), "too big").when(is_code, F.lit(None)).otherwise(F.concat(F.lit("not indexed: "), F.col("_kind"))))
    return rows.select("path", "bytes", status.alias("status"), reason.alias("reason"))


def status_counts(inventory: DataFrame) -> DataFrame:
    """status, n for all five statuses, 0 where there is none."""
    counted = inventory.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    every = inventory.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, STATUSES))).alias("status"))
    return every.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def page(inventory: DataFrame, limit: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """A page of an inventory by path and the next cursor, if there are more rows."""
    at = int(cursor or 0)
    ordered = inventory.orderBy("path")
    more = ordered.offset(at + limit).limit(1).count() > 0
    return ordered.offset(at).limit(limit), str(at + limit) if more else None


def conversion_state(notes: DataFrame, originals: DataFrame) -> DataFrame:
    """path, source_state of converted notes (path, source, text_sha256) against originals (path, content)."""
    now = originals.select(F.col("path").alias("source"), F.sha2("content", 256).alias("now_sha256"))
    state = F.when(F.col("text_sha256").isNull() | F.col("now_sha256").isNull(), "unverifiable").when(F.col("text_sha256") == F.col("now_sha256"), "current").otherwise("stale")
    return notes.join(now, "source", "left").select("path", "source", state.alias("source_state"))


def read_slice(lines: DataFrame, key: str, start: int = 1, end: int | None = None, max_chars: int = 20_000) -> DataFrame:
    """key, line, text, next_start of the lines from start to end that fit into max_chars (each counts one more for its end)."""
    wanted = lines.where(F.col("line") >= start)
    if end is not None:
        wanted = wanted.where(F.col("line") <= end)
    run = Window.partitionBy(key).orderBy("line")
    wanted = wanted.withColumn("_used", F.sum(F.length("text") + 1).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(key)
    cut = F.min(F.when(F.col("_used") > max_chars, F.col("line"))).over(whole)
    return wanted.withColumn("next_start", cut).where(F.col("_used") <= max_chars).select(key, "line", "text", "next_start")


def section_range(outline: DataFrame, key: str, title: Column | str, lines_of: DataFrame) -> DataFrame:
    """key, title, start, end, status of the section that a title names: an exact match without case, else a unique prefix.

    outline (key, level, title, line); lines_of (key, n_lines). The section ends before the next heading of its level or above.
    """
    wanted = F.lower(F.lit(title)) if isinstance(title, str) else F.lower(title)
    own = F.lower("title")
    rows = outline.withColumn("_exact", own == wanted).where(F.startswith(own, wanted))
    each = Window.partitionBy(key)
    rows = rows.withColumns({"_any": F.max("_exact").over(each)}).where(F.col("_exact") == F.col("_any"))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(each))
    later = outline.select(F.col(key).alias("_k"), F.col("level").alias("_l"), F.col("line").alias("_line"))
    ends = rows.join(later, (F.col(key) == F.col("_k")) & (F.col("_line") > F.col("line")) & (F.col("_l") <= F.col("level")), "left")
    ends = ends.groupBy(key, "title", "line", "_n").agg((F.min("_line") - 1).alias("_end"))
    return ends.join(lines_of, key).select(
        key, "title", F.col("line").alias("start"), F.coalesce("_end", "n_lines").alias("end"),
        F.when(F.col("_n") > 1, "bad_argument").otherwise("ok").alias("status"))


def epoch(files: DataFrame) -> DataFrame:
    """One row, epoch: SHA-1 over all (path, mtime, bytes) in order of path; per-file digests are what is gathered."""
    line = F.concat_ws("\x1f", "path", F.col("mtime").cast("string"), F.col("bytes").cast("string"))
    parts = files.select(F.substring(F.sha1("path"), 1, 2).alias("b"), F.sha1(line).alias("h")).groupBy("b")
    parts = parts.agg(F.sha1(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("h"))
    return parts.agg(F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "")).alias("epoch"))


def looks_like_code(files: DataFrame, sample: int = 400) -> DataFrame:
    """One row, is_code: a root marker file, or more code than prose among the first files by path."""
    marked = files.agg(F.max(F.col("path").isin(*MARKERS)).alias("marked"))
    kinds = files.orderBy("path").limit(sample).select(suffix(F.col("path")).alias("k"))
    counted = kinds.agg(F.count_if(F.col("k").isin(*(s for s, n in code.LANGUAGES.items() if n not in code.BARE))).alias("c"), F.count_if(F.col("k").isin(*MARKED_PROSE)).alias("p"))
    return counted.crossJoin(marked).select((F.coalesce("marked", F.lit(False)) | (F.col("c") > F.col("p"))).alias("is_code"))
