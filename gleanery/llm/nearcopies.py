"""Near copies by exact similarity: SimHash tables and min-hash bands propose pairs, the sets of word shingles decide.

A text's set holds a 64-bit hash of each distinct shingle (words lower-cased in A-Z); the similarity of two texts is the
Jaccard similarity of their sets. Pairs come from two sources. The covering tables over SimHash fingerprints give every
pair within RADIUS bits, which joins close families. At a similarity of 0.8 two fingerprints differ in 10 of 64 bits on
average, far beyond any radius with a bearable number of tables, so min-hash bands propose the rest: a text's least hash
is taken in BANDS * ROWS orders, and texts that agree in all ROWS orders of a band meet in a bucket. A pair of similarity
s meets nowhere with chance (1 - s^ROWS)^BANDS, 5e-6 at 0.8, wherever in the text it differs.

Texts that meet are compared in the task of their bucket: by their sets if both have EXACT shingles or fewer, else by
their sizes and their sketches, a byte of each least hash. The share of equal bytes estimates the similarity with a
deviation of 0.026 at 0.8; a pair is passed over only MARGIN = 4.5 deviations below the bound (3e-6). First each bucket
gives a spanning forest of its most similar pairs; these pairs and those of the SimHash tables are confirmed by their
sets, and their components found. Then the other pairs of a bucket that lie in different components and may reach the
bound are confirmed too. So every pair that meets and reaches the bound lies in one component, while a family that hangs
together costs one pair a text. Only a family of long texts whose members mostly stay just below the bound costs as many
pairs as have estimates near it.

A bucket of over LARGE texts is dealt by hash into parts of about LARGE, each its own task, for the forests; for the
remaining pairs blocks of the texts outside the bucket's largest component meet each part. Nothing holds a whole bucket.
Texts are told apart by a 64-bit hash (node).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.columns import slices
from gleanery.llm.components import roots
from gleanery.llm.substrings import word_hashes
from gleanery.session import materialise, release

BANDS, ROWS = 40, 6
RADIUS = 4
MARGIN = 4.5
#: Texts of a bucket that are compared in one task; shingles of a set that is kept beside its sketch.
LARGE, EXACT = 1_024, 256
#: Hashes that are put into all orders at once.
CHUNK = 256
_ODD = np.random.Generator(np.random.PCG64(42)).integers(0, 2**64, BANDS * ROWS + 64, np.uint64) | np.uint64(1)
ORDERS, PLACES = _ODD[: BANDS * ROWS], _ODD[BANDS * ROWS :]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a shorter text has one, its whole sequence, a wordless one none."""
    raws = [(t or "").encode().lower() for t in texts]
    codes, at = word_hashes(b"\n".join(raws))
    first = np.searchsorted(at, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    whole = np.full(max(0, len(codes) - size + 1), size, np.uint64)
    for i in range(size):
        whole += codes[i : i + len(whole)] * PLACES[i]
    whole = mixed(whole)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        elif b > a:
            yield mixed(np.array([b - a], np.uint64) + (codes[a:b] * PLACES[: b - a]).sum(dtype=np.uint64))
        else:
            yield np.empty(0, np.uint64)


def signs(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The bucket of each band, as signed numbers, and the sketch of a set."""
    least = np.full(len(ORDERS), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[i : i + CHUNK, None] * ORDERS).min(axis=0), out=least)
    spread = mixed(least)
    keys = (spread.reshape(BANDS, ROWS) * PLACES[:ROWS]).sum(axis=1, dtype=np.uint64)
    keys = mixed(keys + np.arange(BANDS, dtype=np.uint64) * PLACES[ROWS]).view(np.int64)
    return keys, (spread >> np.uint64(56)).astype(np.uint8).tobytes()


def texts_signed(texts: DataFrame, size: int) -> DataFrame:
    """node, code (SimHash of the set), size, buckets, sketch and, if small, the set (four bytes a hash) of the texts (node, text); of equal texts in one task, one."""
    from gleanery.llm.simhash import majority

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, 1, 1 << 20):
            nodes = part.column(0).to_pylist()
            new = [i for i, n in enumerate(nodes) if n not in seen and not seen.add(n)]
            values = part.column(1).take(pa.array(new, pa.int64())).to_pylist()
            codes, keys, sketches, sizes, small = [], [], [], [], []
            for hashes in shingle_sets(values, size):
                bits = majority(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)) if len(hashes) else bytes(8)
                codes.append(int.from_bytes(bits, "little", signed=True))
                buckets, sketch = signs(hashes)
                keys.append(buckets)
                sketches.append(sketch)
                sizes.append(len(hashes))
                small.append((hashes >> np.uint64(32)).astype("<u4").tobytes() if len(hashes) <= EXACT else None)
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i in new], pa.int64()), pa.array(codes, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(sketches, pa.binary()),
                 pa.array(small, pa.binary())],
                ["node", "code", "size", "buckets", "sketch", "small"])

    return texts.mapInArrow(run, "node long, code long, size int, buckets array<long>, sketch binary, small binary")


def sets_of(texts: DataFrame, size: int) -> DataFrame:
    """node and set (its hashes) of the texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1 << 20):
            found = [h.view(np.int64) for h in shingle_sets(part.column(1).to_pylist(), size)]
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), pa.int64()))], ["node", "set"])

    return texts.mapInArrow(run, "node long, set array<long>")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        if held and held[-1].column(0)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(int(cuts[-1]) if len(cuts) else 0))
    if held:
        yield pa.Table.from_batches(held)


def common(sets: list[bytes]) -> np.ndarray:
    """How many hashes each two of some sets share."""
    lengths = [len(x) // 4 for x in sets]
    owner = np.repeat(np.arange(len(sets)), lengths)
    values, at, n = np.unique(np.frombuffer(b"".join(sets), "<u4"), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1  # hashes of one set alone are shared by none
    shared = n[at] > 1
    owner, at = owner[shared], place[at[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4_096):
        a, b = np.searchsorted(at, (low, low + 4_096))
        held = np.zeros((len(sets), 4_096), np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        out += held @ held.T
    return out


def likeness(part: pa.Table, similarity: float) -> np.ndarray:
    """The similarity of each two rows (size, sketch, small): exact or estimated; -1 for those that can't reach the bound."""
    size = part["size"].to_numpy().astype(np.float64)
    sketches = np.frombuffer(b"".join(part["sketch"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
    out = np.empty((len(size), len(size)))
    for i, one in enumerate(sketches):
        out[i] = np.count_nonzero(sketches == one, axis=1)
    out = (out / sketches.shape[1] - 1 / 256) / (1 - 1 / 256)
    few, many = np.minimum.outer(size, size), np.maximum.outer(size, size)
    out[(out < similarity - MARGIN * (similarity * (1 - similarity) / sketches.shape[1]) ** 0.5) | (few < similarity * many)] = -1
    small = part["small"].to_pylist()
    exact = np.array([i for i, x in enumerate(small) if x is not None], np.int64)
    if len(exact) > 1:
        both = common([small[i] for i in exact])
        whole = np.add.outer(size[exact], size[exact]) - both
        share = np.where(whole == 0, 1.0, both / np.maximum(whole, 1))
        # Sets of the first 32 bits of their hashes: equal ones by chance may hide or feign a shingle or two.
        out[np.ix_(exact, exact)] = np.where(share >= similarity - 2 / np.maximum(whole, 1), share, -1)
    return out


def spanning_forest(like: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a spanning forest of greatest similarity, without those of -1."""
    n = len(like)
    best, source, out, links = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool), []
    at = 0
    for _ in range(n - 1):
        out[at] = False
        nearer = like[at] > best
        best[nearer], source[nearer] = like[at][nearer], at
        at = int(np.where(out, best, -2).argmax())
        if best[at] >= 0:
            links.append((int(source[at]), at))
    return links


def pairs_in(rows: DataFrame, of, columns: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, that a function finds among the rows of each value of deal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups_of(batches):
            if part.num_rows > 1:
                nodes = part["node"].to_numpy()
                a, b = of(part)
                if len(a):
                    a, b = nodes[a], nodes[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = rows.select("deal", *columns.split()).repartition("deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, set) have at least this Jaccard similarity; two empty sets have 1."""
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = both.select("a", "b", F.size(F.array_intersect("_a", "_b")).alias("n"), (F.size("_a") + F.size("_b")).alias("m"))
    return common.where((F.col("m") == 0) | (F.col("n") / (F.col("m") - F.col("n")) >= similarity)).select("a", "b")


def groups(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """node and root of the components of near copies among texts (node, text), but for the roots themselves."""
    from gleanery.llm.simhash import links_within

    signed = materialise(texts_signed(texts, size), "signs")
    rows = signed.select(F.explode("buckets").alias("bucket"), "node")
    shared = rows.groupBy("bucket").agg(F.min("node").alias("l"), F.max("node").alias("h"), F.count(F.lit(1)).alias("n")).where("l <> h")
    parts = F.ceil(F.col("n") / LARGE)
    met = rows.join(shared.select("bucket", "n"), "bucket").distinct()
    met = materialise(met.select("bucket", "node", parts.alias("parts"), F.pmod(F.xxhash64("bucket", "node"), parts).alias("part")), "met")
    codes = signed.groupBy("code").agg(F.min("node").alias("least"), F.max("node").alias("h"))
    equal = signed.select("node", "code").join(codes.where("least <> h"), "code").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    close = links_within(codes.select(F.col("least").alias("node"), "code", F.lit(None).cast("binary").alias("seal")), RADIUS)
    covered = materialise(equal.union(close.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "covered")
    wanted = met.select("node").union(covered.select("a")).union(covered.select("b")).distinct()
    sets = materialise(sets_of(texts.dropDuplicates(["node"]).join(wanted, "node", "left_semi"), size), "sets")
    sketches = signed.select("node", "size", "sketch", "small").dropDuplicates(["node"]).join(met.select("node").distinct(), "node", "left_semi")
    sketches = materialise(sketches, "sketches")

    def forest(part: pa.Table):
        links = np.array(spanning_forest(likeness(part, similarity)), np.int64).reshape(-1, 2)
        return links[:, 0], links[:, 1]

    first = pairs_in(met.withColumn("deal", F.xxhash64("bucket", "part")).join(sketches, "node"), forest, "node size sketch small")
    first = materialise(first.union(covered).distinct(), "first-pairs")
    links = materialise(confirmed(first, sets, similarity), "links")

    def apart(part: pa.Table):
        root, asks = part["root"].to_numpy(), part["asks"].to_numpy() == 1
        if asks.all() or not asks.any():
            return [], []
        near = (likeness(part, similarity) >= 0) & asks[:, None] & ~asks[None, :] & (root[:, None] != root[None, :])
        return np.nonzero(near)

    hung = roots(links)
    rooted = materialise(met.join(hung, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    counts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    most = counts.groupBy("bucket").agg(
        F.max_by("root", F.struct("k", "root")).alias("most"), F.max("k").alias("k"), F.sum("k").alias("all")).where("k < all")
    rest = rooted.join(most.select("bucket", "most", F.ceil((F.col("all") - F.col("k")) / LARGE).alias("blocks")), "bucket")
    block = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks"))
    there = rest.withColumn("asks", F.lit(0)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    ask = rest.where("root <> most").withColumn("asks", F.lit(1)).withColumn("block", block)
    ask = ask.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    keep = ["node", "root", "asks", F.xxhash64("bucket", "part", "block").alias("deal")]
    late = pairs_in(there.select(*keep).union(ask.select(*keep)).join(sketches, "node"), apart, "node size sketch small root asks")
    found = roots(links.union(confirmed(late, sets, similarity)))
    release(close.near, signed, met, covered, sets, sketches, first, links, rooted, hung)
    return found
