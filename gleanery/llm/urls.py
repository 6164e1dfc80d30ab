"""URL filters: a sorted array of 64-bit digests, memory-mapped on every executor and probed by binary search.

A rule is (verdict, host, path). It fits its host and every subdomain of it where the url's path starts with the
rule's path; of several rules that fit, the longest (host and path together) decides, of equal ones the one whose host
is longer. Null urls and urls without "://" have an empty host and an empty path, fit no rule and get the default
verdict. Equal rules collapse; where they contradict each other, "block" holds.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.columns import UPPER
from gleanery.session import write_shared_bytes

MAGIC = b"URLDIG01"
#: Beyond this size the index isn't handed to every executor; the rules are joined by key instead.
MAX_INDEX_BYTES = 256 << 20
SEPARATOR = "\x00"


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased) and path; both empty for null and for urls without a scheme."""
    pattern = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(pages[url], F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), UPPER, UPPER.lower())
    return pages.withColumns({"host": host, "path": F.regexp_extract(text, pattern, 2)})


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def build_index(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The file: header, sorted digests, offsets of the stored strings, verdicts, then the strings themselves."""
    kept: dict[bytes, int] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {(verdict, host, path)!r}")
        key = f"{host.translate(str.maketrans(UPPER, UPPER.lower()))}{SEPARATOR}{path}".encode()
        kept[key] = max(kept.get(key, 0), int(verdict == "block"))
    rows = sorted((digest(k), k, v) for k, v in kept.items())
    keys = np.array([r[0] for r in rows], dtype="<u8")
    offsets = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8")
    verdicts = np.array([r[2] for r in rows], dtype="u1")
    shapes = sorted({(k.split(b"\0")[0].count(b".") + 1, len(k.decode().split(SEPARATOR)[1])) for k in kept})
    shape = np.array(shapes, dtype="<u4").reshape(-1, 2)
    head = MAGIC + struct.pack("<QQ", len(rows), len(shapes))
    return b"".join([head, shape.tobytes(), keys.tobytes(), offsets.tobytes(), verdicts.tobytes(), *(r[1] for r in rows)])


class DigestIndex:
    """An index file seen through a memory map: only the pages that a probe touches are read."""

    def __init__(self, buffer) -> None:
        if bytes(buffer[:8]) != MAGIC:
            raise ValueError("not a digest index")
        n, m = struct.unpack_from("<QQ", buffer, 8)
        at = 24
        self.shapes = [(int(a), int(b)) for a, b in np.frombuffer(buffer, "<u4", 2 * m, at).reshape(-1, 2)]
        at += 8 * m
        self.keys = np.frombuffer(buffer, "<u8", n, at)
        at += 8 * n
        self.offsets = np.frombuffer(buffer, "<u8", n + 1, at)
        at += 8 * (n + 1)
        self.verdicts = np.frombuffer(buffer, "u1", n, at)
        self.blob, self.base = buffer, at + n

    @classmethod
    def open(cls, path: str) -> DigestIndex:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def stored(self, i: int) -> bytes:
        return bytes(self.blob[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])])

    def find(self, keys: list[bytes]) -> np.ndarray:
        """For each key the position of its stored string, or -1; equal digests of other strings are passed over."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys) or not keys:
            return out
        wanted = np.array([digest(k) for k in keys], dtype="<u8")
        first = np.searchsorted(self.keys, wanted, "left")
        hit = np.flatnonzero((first < len(self.keys)) & (self.keys[np.minimum(first, len(self.keys) - 1)] == wanted))
        for j in hit.tolist():
            i = int(first[j])
            while i < len(self.keys) and self.keys[i] == wanted[j]:
                if self.stored(i) == keys[j]:
                    out[j] = i
                    break
                i += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str, int] | None]:
        """The longest fitting rule of every url as (rule, 1 for block), or None."""
        owners: list[int] = []
        ranks: list[tuple[int, int]] = []
        keys: list[bytes] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            labels = host.split(".")
            for depth, length in self.shapes:
                if depth <= len(labels) and length <= len(path):
                    suffix = ".".join(labels[-depth:])
                    owners.append(i)
                    ranks.append((len(suffix) + length, len(suffix)))
                    keys.append(f"{suffix}{SEPARATOR}{path[:length]}".encode())
        best: dict[int, tuple[tuple[int, int], int]] = {}
        found = self.find(keys)
        for j in np.flatnonzero(found >= 0).tolist():
            entry = (ranks[j], int(found[j]))
            if owners[j] not in best or entry[0] > best[owners[j]][0]:
                best[owners[j]] = entry
        out: list[tuple[str, int] | None] = [None] * len(hosts)
        for i, (_, at) in best.items():
            out[i] = (self.stored(at).decode().replace(SEPARATOR, ""), int(self.verdicts[at]))
        return out


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], key: str = "page_id", url: str = "url",
    default: str = "allow", max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """key, host, path, rule (null if none fits) and verdict of every row of pages.

    The rules are a driver-side list; an index of up to max_index_bytes is written to the shared folder, copied to each
    executor by Spark and memory-mapped there. A larger one takes judge_urls_by_join.
    """
    spark = pages.sparkSession
    rules = list(rules)
    index = build_index(rules)
    if len(index) > max_index_bytes:
        frame = spark.createDataFrame(rules, "verdict string, host string, path string")
        return judge_urls_by_join(pages, frame, key, url, default)
    uri = write_shared_bytes(spark, "url-digests", index)
    name = uri.rpartition("/")[2]
    spark.sparkContext.addFile(uri)
    parts = url_parts(pages.select(key, url), url).select(key, "host", "path")
    schema = f"{key} {parts.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = DigestIndex.open(SparkFiles.get(name))
        for batch in batches:
            found = rows.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            rule = pa.array([x and x[0] for x in found], pa.string())
            verdict = pa.array([default if x is None else ("allow", "block")[x[1]] for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [key, "host", "path", "rule", "verdict"])

    return parts.mapInArrow(probe, schema)


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """The same answer where the rules outgrow one file: candidates of the rules' shapes meet them in an equi-join.

    The shapes (labels of the host, length of the path) are few whatever the number of rules.
    """
    spark: SparkSession = pages.sparkSession
    low = rules.select(
        F.translate("host", UPPER, UPPER.lower()).alias("r_host"), F.col("path").alias("r_path"),
        (F.col("verdict") == "block").alias("r_block"),
    ).groupBy("r_host", "r_path").agg(F.max("r_block").alias("r_block"))
    shapes = low.select(F.size(F.split("r_host", r"\.")).alias("depth"), F.length("r_path").alias("length")).distinct()
    parts = url_parts(pages.select(key, url), url).select(key, "host", "path").withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    tries = parts.where("host <> ''").join(F.broadcast(shapes) if shapes.count() <= 10_000 else shapes,
                                            (F.size(labels) >= F.col("depth")) & (F.length("path") >= F.col("length")))
    tries = tries.select("_row", F.array_join(F.slice(labels, -F.col("depth"), F.col("depth")), ".").alias("r_host"),
                         F.expr("substring(path, 1, length)").alias("r_path"))
    best = tries.join(low, ["r_host", "r_path"]).groupBy("_row").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_block"),
                 F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))).alias("best"))
    return parts.join(best, "_row", "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"),
        F.when(F.col("best.r_block"), "block").when(F.col("best").isNotNull(), "allow").otherwise(default).alias("verdict"))
