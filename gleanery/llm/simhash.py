"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's features. To find all pairs of fingerprints
within a radius r, every bit position gets a vector of r + 1 bits, and for every nonzero vector there is a table keyed
by the bits whose vectors have an odd product with it. For any r positions some table looks at none of them, so two
fingerprints that differ in r bits at most agree in that table's key: no pair is missed.

Equal fingerprints stand once. The rows of a table's bucket are compared in one task, which yields only a spanning
forest of the bucket's links. A bucket of over LARGE rows is dealt anew: its rows agree in all bits of the key, so the
same construction over the remaining bits gives smaller buckets with the same guarantee. Rows of such a bucket agree in
about 48 bits, so it holds 2^16 different fingerprints or so at the very most, whatever the data.

Texts are lower-cased in A-Z; words are runs without white space. A text with fewer words than a shingle has one, its
whole sequence; a null or wordless text has fingerprint 0, which links like any other. Rows with a null key take part;
a component's id is its least non-null key. Repeated rows and equal texts share a component.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import nearcopies
from gleanery.llm.columns import slices
from gleanery.llm.components import roots
from gleanery.session import materialise, release

SEED = 42
BITS = 64
#: Rows of a bucket that are compared without dealing it anew.
LARGE = 4_096


def majority(hashes: np.ndarray) -> bytes:
    """Bits set in over half of the rows of an array of little-endian bytes."""
    ones = np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def shingles(text: str | None, size: int) -> list[bytes]:
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[s:e] for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(features: list[bytes]) -> int:
    """The 64-bit fingerprint, as a signed number."""
    if not features:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(f, SEED) for f in features], dtype="<u8")
    return int.from_bytes(majority(hashes.view(np.uint8).reshape(-1, 8)), "little", signed=True)


def masks(radius: int, within: int = 2**BITS - 1) -> list[int]:
    """A mask over the bits of within for each table, as signed numbers."""
    positions = [i for i in range(BITS) if within >> i & 1]
    vectors = range(1, 2 ** (radius + 1))
    given = {p: vectors[(k * 11 + k // len(vectors) * 5) % len(vectors)] for k, p in enumerate(positions)}
    found = [sum(1 << p for p, v in given.items() if (v & w).bit_count() & 1) for w in vectors]
    return [m - 2**BITS if m >= 2 ** (BITS - 1) else m for m in found]


def linked(codes: np.ndarray, seals: np.ndarray | None, radius: int, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among rows: at most radius differing bits of the code, and most of the seal."""
    links: list[tuple[int, int]] = []
    open_ = np.arange(len(codes))
    while len(open_) > 1:
        reached, open_ = [int(open_[0])], open_[1:]
        while reached and len(open_):
            at = reached.pop()
            near = np.bitwise_count(codes[open_] ^ codes[at]) <= radius
            if seals is not None and near.any():
                some = open_[near]
                near[near] = np.bitwise_count(seals[some] ^ seals[at]).sum(axis=1) <= most
            if near.any():
                found = open_[near].tolist()
                links += [(at, j) for j in found]
                reached += found
                open_ = open_[~near]
    return links


def compare(rows: DataFrame, radius: int, most: int | None, large: int | None) -> DataFrame:
    """Buckets of rows (bucket, mask, code, node, seal) compared: links (a, b), or rows of buckets over large, by kind."""
    schema = "kind int, a long, b long, mask int, bucket long, code long, seal binary"
    names = ["kind", "a", "b", "mask", "bucket", "code", "seal"]
    blank = {"kind": 0, "a": None, "b": None, "mask": None, "bucket": None, "code": None, "seal": None}
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def batch_of(**columns) -> pa.RecordBatch:
        n = len(columns["a"])
        arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [blank[c]] * n), k) for c, k in zip(names, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip(arrays, kinds, strict=True)], names)

    def forest(part: pa.Table) -> list[tuple[int, int]]:
        codes, nodes = part["code"].to_numpy().view(np.uint64), part["node"].to_numpy()
        seals = None
        if most is not None:
            seals = np.frombuffer(b"".join(part["seal"].to_pylist()), "<u8").reshape(len(codes), -1)
        return [(int(nodes[i]), int(nodes[j])) for i, j in linked(codes, seals, radius, most or 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_rows, passing, current = 0, False, None

        def flush() -> list[tuple[int, int]]:
            return forest(pa.Table.from_batches(held)) if held_rows > 1 and not passing else []

        def passed(part: pa.RecordBatch) -> pa.RecordBatch:
            get = lambda name: part.column(part.schema.get_field_index(name))
            return batch_of(kind=[1] * part.num_rows, a=get("node"), mask=get("mask"), bucket=get("bucket"), code=get("code"), seal=get("seal"))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            links: list[tuple[int, int]] = []
            single = np.diff(cuts) == 1
            single[[0, -1]] = False
            for k in np.flatnonzero(~single).tolist():
                part = batch.slice(int(cuts[k]), int(cuts[k + 1] - cuts[k]))
                if current != keys[cuts[k]]:
                    links += flush()
                    held, held_rows, passing, current = [], 0, False, keys[cuts[k]]
                if passing:
                    yield passed(part)
                    continue
                held.append(part)
                held_rows += part.num_rows
                if large is not None and held_rows > large:
                    for one in held:
                        yield passed(one)
                    held, held_rows, passing = [], 0, True
            if links:
                yield batch_of(a=[x for x, _ in links], b=[y for _, y in links])
        if links := flush():
            yield batch_of(a=[x for x, _ in links], b=[y for _, y in links])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def links_within(entities: DataFrame, radius: int, most: int | None = None, large: int = LARGE) -> DataFrame:
    """Links (a, b) that connect all entities (node, code, seal) within the radius of each other, directly or over others.

    The links read a shared table, near, that can be released once they have been used.
    """
    first = masks(radius)
    tables = F.array(*(F.struct(F.lit(i).alias("mask"), F.lit(m).cast("long").alias("bits")) for i, m in enumerate(first)))
    keep = ["code", "node", "seal"]
    rows = entities.select(*keep, F.explode(tables).alias("t"))
    rows = rows.select(F.xxhash64("t.mask", F.col("code").bitwiseAND(F.col("t.bits"))).alias("bucket"), "t.mask", *keep)
    found = materialise(compare(rows, radius, most, large), "near")
    links = found.where("kind = 0").select("a", "b")
    large_rows = found.where("kind = 1")
    if large_rows.limit(1).count():  # by the bits that their first key left out
        second = F.from_json(F.lit(json.dumps([masks(radius, ~m & (2**BITS - 1)) for m in first])), "array<array<bigint>>")
        again = large_rows.select("bucket", "mask", "code", F.col("a").alias("node"), "seal", F.posexplode(F.get(second, F.col("mask"))).alias("n", "bits"))
        again = again.select(F.xxhash64("bucket", "n", F.col("code").bitwiseAND(F.col("bits"))).alias("bucket"), "mask", *keep)
        links = links.unionByName(compare(again, radius, most, None).select("a", "b"))
    links.near = found
    return links


def with_codes(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key and code (signed) of every row."""
    source = docs.select(docs[key].alias("key"), docs[text])
    schema = f"key {source.schema['key'].dataType.simpleString()}, code long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1 << 20):
            codes = [fingerprint(shingles(t, size)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.int64())], ["key", "code"])

    return source.mapInArrow(run, schema)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """key, code and component_id of every row: rows link whose fingerprints of word shingles differ in at most radius bits."""
    coded = materialise(with_codes(docs, key, text, size), "codes").withColumn("node", F.col("code"))
    entities = coded.groupBy("node", "code").agg(F.min("key").alias("least"))
    links = links_within(entities.select("node", "code", F.lit(None).cast("binary").alias("seal")), radius)
    hung = roots(links)
    release(links.near)
    placed = entities.join(hung, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("node", "root").join(named, "root").select("node", "component_id")
    return coded.join(named, "node").select(F.col("key").alias(key), "code", "component_id")


def fingerprint_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of every row."""
    return components(docs, key, text, size, radius).select(key, F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def text_hash(text: Column) -> Column:
    """A 64-bit hash of a text, null as the empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_nodes(docs: DataFrame, text: str, node: str = "node") -> DataFrame:
    """docs with a number for each text that no other text has: its hash with the lowest bit cleared, and where texts share that, an odd number of its own.

    Texts are told apart by 128 bits of their SHA-256. The texts that share a hash are a handful in any corpus: they are numbered,
    and their table meets docs in a join that Spark broadcasts by its size.
    """
    even = F.shiftleft(F.shiftright(text_hash(docs[text]), 1), 1)
    mark = F.left(F.sha2(F.coalesce(docs[text], F.lit("")), 256), F.lit(32))
    marked = docs.select(even.alias("_even"), mark.alias("_mark"))
    crowded = marked.groupBy("_even").agg(F.min("_mark").alias("l"), F.max("_mark").alias("h")).where("l <> h").select("_even")
    crowded = materialise(crowded, "crowded")
    shared = marked.join(crowded, "_even", "left_semi").select("_mark").distinct()
    own = materialise(shared.withColumn("_own", F.monotonically_increasing_id() * 2 + 1), "told-apart")
    rows = docs.withColumns({"_even": even, "_mark": F.when(F.lit(own.limit(1).count() > 0), mark)})
    release(crowded)
    rows = rows.join(own, "_mark", "left").withColumn(node, F.coalesce("_own", "_even"))
    return rows.select(*docs.columns, node)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs but for all of a group of near copies (Jaccard similarity of the shingles) save one.

    That of the least key stays, null keys last; rows of one key stand in order of their texts' hashes, then of a hash of
    their other columns, so a row is judged by its own text whatever other rows share its key. Of rows equal in all
    columns one stays. All null and wordless texts are copies of each other; an empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in (key, text) and "map<" not in docs.schema[c].dataType.simpleString()]
    numbered = with_nodes(docs, text, "_node")
    tie = F.xxhash64(*others) if others else F.lit(0).cast("long")
    rows = numbered.select(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_node").alias("node"), tie.alias("tie"))
    hung = nearcopies.groups(numbered.select(F.col("_node").alias("node"), F.col(text).alias("text")), size, similarity)
    placed = rows.join(hung, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = placed.groupBy("root").agg(F.min(F.struct("none", "key", "node", "tie")).alias("least"))
    kept = kept.select(F.col("least.key").alias("_key"), F.col("least.node").alias("_node"), F.col("least.tie").alias("_tie"))
    # A node belongs to one root, so it alone names the row that stays but for its key and tie.
    marked = numbered.withColumn("_tie", tie).join(kept.withColumnRenamed("_tie", "_kept_tie"), "_node")
    marked = marked.where(F.col(key).eqNullSafe(F.col("_key")) & (F.col("_tie") == F.col("_kept_tie")))
    return marked.dropDuplicates(["_node"]).select(*docs.columns)
