"""Exact nearest vectors for many queries: rows in groups by their angle to a pivot, queries sent only where they can win.

Each vector belongs to the pivot with the smallest angle. The vectors of a pivot are dealt into groups of neighbouring
angles, of about GROUP_ROWS rows each, a crowded angle by hash into several. By the triangle inequality for angles, no
vector of a group is nearer to a query than the gap between the query's angle to that pivot and the group's range of
angles; the greatest and least norms turn that into a bound on the product. A first pass asks each query's own group
alone and gives a score that k rows reach; the second sends the query to the groups whose bound reaches that score.

A group and a wave of queries meet in one task as two blocks, which yields the first k rows of a query alone. Scores are
dot products rounded to DIGITS; ties go to the smaller key. On vectors without structure no bound helps and all pairs are
computed, block by block; `pairs` says how many. Pivots come from SAMPLE rows at most and change no result. Null vectors
take no part; shorter ones count as ending in zeros; an empty table or no queries give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import materialise

PIVOTS, BINS, SAMPLE, DIGITS = 16, 64, 2_000, 6
#: Rows of a group and queries of a wave, about.
GROUP_ROWS, WAVE = 8_192, 2_048
#: Products that a task holds at a time; choosing among them takes some copies of them.
MOST_SCORES = 1 << 20
#: What rounding to DIGITS and the angles' own errors may take from a bound.
SLACK = 2e-6


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows, shorter ones with zeros at their ends."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dims))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def angles(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The angles of rows to pivots of length one, and the rows' norms."""
    norms = np.linalg.norm(rows, axis=1)
    return np.arccos(np.clip(rows @ pivots.T / np.maximum(norms, 1e-300)[:, None], -1, 1)), norms


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of a sample, each next one the farthest from those before, scaled to length one."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen, near = [units[0]], units @ units[0]
    while len(chosen) < n and near.min() < 1 - 1e-9:
        chosen.append(units[near.argmin()])
        near = np.maximum(near, units @ chosen[-1])
    return np.array(chosen)


class Grouped:
    """Rows in groups: table (key, owner, vector, group), and for each range of groups its pivot, first group, parts, angles, norms and rows."""

    def __init__(self, rows: DataFrame, key: str, vector: str, owner: str | None, pivots: int, group_rows: int) -> None:
        rows = rows.select(rows[key].alias("key"), (rows[owner] if owner else F.lit(None).cast("int")).alias("owner"), rows[vector].cast("array<double>").alias("vector"))
        rows = rows.where("vector IS NOT NULL")
        self.dims = dims = rows.agg(F.max(F.size("vector"))).first()[0] or 1
        drawn = rows.select("vector", F.xxhash64("key").alias("mark")).orderBy("mark", "vector").limit(SAMPLE).select("vector").toArrow()
        self.pivots = own = far_apart(matrix(drawn["vector"].combine_chunks(), dims) if drawn.num_rows else np.zeros((1, dims)), pivots)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, norms = angles(matrix(batch.column(2), dims), own)
                cell = found.argmin(1)
                angle = found[np.arange(len(cell)), cell] if len(cell) else np.zeros(0)
                bin_ = cell * BINS + np.minimum((angle / np.pi * BINS).astype(np.int64), BINS - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bin_.astype(np.int32)), pa.array(angle), pa.array(norms)], [*batch.schema.names, "bin", "angle", "norm"])

        kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        placed = materialise(rows.mapInArrow(run, f"{kinds}, bin int, angle double, norm double"), "vectors-placed")
        stats = placed.groupBy("bin").agg(F.count(F.lit(1)), F.min("angle"), F.max("angle"), F.min("norm"), F.max("norm")).orderBy("bin").collect()  # PIVOTS * BINS rows
        ranges: list[list] = []
        at = {}
        for bin_, n, *rest in stats:  # neighbouring small bins of a pivot make one range
            last = ranges[-1] if ranges else None
            if last and last[0] == bin_ // BINS and last[1] + n <= group_rows:
                ranges[-1] = [last[0], last[1] + n, *(f(a, b) for f, a, b in zip((min, max, min, max), last[2:], rest, strict=True))]
            else:
                ranges.append([bin_ // BINS, n, *rest])
            at[bin_] = len(ranges) - 1
        parts = [-(-r[1] // group_rows) for r in ranges]
        first = np.cumsum([0, *parts]).tolist()
        self.ranges = [(cell, first[i], parts[i], low, high, least, most, n) for i, (cell, n, low, high, least, most) in enumerate(ranges)]
        bins = max(at, default=0) + 1
        known = F.array(*(F.lit(at.get(b)).cast("int") for b in range(bins)))
        which = F.get(known, F.col("bin"))
        base, split = (F.get(F.array(*map(F.lit, x or [0])), which) for x in (first[:-1], parts))
        self.table = placed.select("key", "owner", "vector", (base + F.pmod(F.xxhash64("key", "vector"), split)).cast("int").alias("group"))
        self.groups = first[-1]


def bound(ranges: list[tuple], pivots: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each query and range of groups what no product can exceed."""
    angle, norms = angles(queries, pivots)
    cell, low, high, least, most = (np.array([r[i] for r in ranges]) for i in (0, 3, 4, 5, 6))
    own = angle[:, cell.astype(int)]
    near = np.cos(np.maximum(0, np.maximum(low - own, own - high)))
    return norms[:, None] * np.where(near > 0, most, least) * near


def sent(queries: DataFrame, grouped: Grouped, own_only: bool) -> DataFrame:
    """queries (qid, query, reach) with a row for each group that each has to ask: all whose bound reaches reach, or the likeliest alone."""
    dims, ranges, pivots, kind = grouped.dims, grouped.ranges, grouped.pivots, queries.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if ranges else ():
            most = bound(ranges, pivots, matrix(batch.column(1), dims))
            if own_only:
                wanted = np.zeros_like(most, bool)
                wanted[np.arange(len(most)), most.argmax(1)] = True
            else:
                wanted = most + SLACK >= batch.column(2).to_numpy()[:, None]
            owner, which = np.nonzero(wanted)
            base, parts = (np.array([r[i] for r in ranges])[which] for i in (1, 2))
            at = np.repeat(np.arange(len(owner)), parts)
            group = base[at] + np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            some = batch.select([0, 1]).take(pa.array(owner[at]))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(group.astype(np.int32))], ["qid", "query", "group"])

    return queries.mapInArrow(run, f"qid {kind}, query array<double>, group int")


def first_k(scores: np.ndarray, keys: pa.Array, owners: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of the k best of each query."""
    order = np.argsort(pc.rank(keys, tiebreaker="dense").to_numpy(), kind="stable")
    scores = scores[:, order]
    if k < scores.shape[1]:
        least = np.partition(scores, -k, axis=1)[:, -k]
        q, r = np.nonzero(scores >= least[:, None])
    else:
        q, r = np.nonzero(np.ones_like(scores, bool))
    at = np.lexsort((r, -scores[q, r], q))
    nth = np.arange(len(at)) - np.searchsorted(q[at], q[at])
    return q[at[nth < k]], order[r[at[nth < k]]]


def best_of_owner(scores: np.ndarray, keys: pa.Array, owners: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of each owner's best row."""
    mine, key = (pc.rank(x, tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64) for x in (owners, keys))
    order = np.lexsort((key, mine))
    starts = np.flatnonzero(np.diff(mine[order], prepend=-1))
    sizes = np.diff(starts, append=len(order))
    scores = scores[:, order]
    top = np.repeat(np.maximum.reduceat(scores, starts, axis=1), sizes, axis=1)
    first = np.minimum.reduceat(np.where(scores == top, np.arange(len(order)), len(order)), starts, axis=1)
    return np.repeat(np.arange(len(scores)), len(starts)), order[first.ravel()]


PRODUCTS = ["qid", "owner", "key", "score", "pairs"]


def products(some: pa.Table, rows: pa.Table, dims: int, k: int, choose: Callable) -> pa.Table:
    """What choose() takes of the products of a wave's queries with a group's rows, which a task has MOST_SCORES of at a time."""
    some, rows = some.combine_chunks(), rows.combine_chunks()
    if not some.num_rows or not rows.num_rows:
        return pa.table([some["qid"].slice(0, 0), rows["owner"].slice(0, 0), rows["key"].slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.int64())], PRODUCTS)
    one = lambda c: c.chunk(0)
    left, right = matrix(one(some["query"]), dims), matrix(one(rows["vector"]), dims)
    step, found = max(1, MOST_SCORES // len(right)), []
    for at in range(0, len(left), step):  # a query's rows don't depend on other queries
        scores = left[at : at + step] @ right.T
        scores = np.floor(scores * 10**DIGITS + 0.5) / 10**DIGITS
        q, r = choose(scores, one(rows["key"]), one(rows["owner"]), k)
        found.append((q + at, r, scores[q, r]))
    q, r, best = (np.concatenate(x) for x in zip(*found, strict=True))
    pairs = np.zeros(len(q), np.int64)
    pairs[:1] = len(left) * len(right)
    return pa.table([some["qid"].take(pa.array(q)), rows["owner"].take(pa.array(r)), rows["key"].take(pa.array(r)), pa.array(best), pa.array(pairs)], PRODUCTS)


def asked(grouped: Grouped, queries: DataFrame, waves: int, k: int, choose: Callable) -> DataFrame:
    """qid, owner, key, score, pairs: what choose() takes of each group for the queries sent to it; pairs on the first row of a task."""
    dims, wave = grouped.dims, F.pmod(F.xxhash64("qid"), F.lit(waves)).cast("int")
    tasks = min(max(1, grouped.groups * waves), 10_000)
    left = queries.withColumn("wave", wave).repartition(tasks, "group", "wave").groupBy("group", "wave")
    every = F.explode(F.sequence(F.lit(0), F.lit(waves - 1)))
    right = grouped.table.withColumn("wave", every).repartition(tasks, "group", "wave").groupBy("group", "wave")
    kinds = [queries.schema["qid"].dataType.simpleString(), *(grouped.table.schema[c].dataType.simpleString() for c in ("owner", "key")), "double", "long"]

    return left.cogroup(right).applyInArrow(lambda some, rows: products(some, rows, dims, k, choose), ", ".join(f"{n} {t}" for n, t in zip(PRODUCTS, kinds, strict=True)))


def stated(queries: DataFrame, qid: str, query: str) -> tuple[DataFrame, int]:
    rows = queries.select(queries[qid].alias("qid"), queries[query].cast("array<double>").alias("query")).where("query IS NOT NULL")
    return rows, max(1, -(-rows.count() // WAVE))


def candidates(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, qid: str, query: str, pivots: int, group_rows: int) -> DataFrame:
    """The rows of the second pass: qid, key, score and pairs."""
    grouped = Grouped(rows, key, vector, None, pivots, group_rows)
    wanted, waves = stated(queries, qid, query)
    reach = F.lit(float("-inf"))
    if grouped.groups > 1:  # else there is nothing to leave out
        seen = asked(grouped, sent(wanted.withColumn("reach", reach), grouped, True), waves, k, first_k)
        nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
        kth = seen.withColumn("n", nth).where(F.col("n") == k).select("qid", F.col("score").alias("reach"))
        wanted = wanted.join(kth, "qid", "left").withColumn("reach", F.coalesce("reach", reach))
    else:
        wanted = wanted.withColumn("reach", reach)
    return asked(grouped, sent(wanted, grouped, False), waves, k, first_k)


def nearest(
    rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", qid: str = "qid", query: str = "query_vector",
    pivots: int = PIVOTS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """qid, key, rank, cosine: the k rows with the greatest product with each query (qid, a distinct id, and query)."""
    found = candidates(rows, queries, key, vector, k, qid, query, pivots, group_rows)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("key"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(F.col("qid").alias(qid), F.col("key").alias(key), "rank", F.col("score").alias("cosine"))


def share_computed(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", qid: str = "qid", query: str = "query_vector",
                   pivots: int = PIVOTS, group_rows: int = GROUP_ROWS) -> float:
    """The share of all pairs whose product the second pass of nearest() computes."""
    n = candidates(rows, queries, key, vector, k, qid, query, pivots, group_rows).agg(F.sum("pairs")).first()[0] or 0
    return n / max(1, rows.where(F.col(vector).isNotNull()).count() * queries.where(F.col(query).isNotNull()).count())


def best_per_owner(rows: DataFrame, queries: DataFrame, owner: str, key: str = "vec_id", vector: str = "embedding", qid: str = "qid", query: str = "query_vector") -> DataFrame:
    """qid, owner, key, cosine: each owner's row with the greatest product with each query; every owner has one, so all groups are asked."""
    grouped = Grouped(rows, key, vector, owner, 1, GROUP_ROWS)
    wanted, waves = stated(queries, qid, query)
    found = asked(grouped, sent(wanted.withColumn("reach", F.lit(float("-inf"))), grouped, False), waves, 1, best_of_owner)
    best = found.groupBy("qid", "owner").agg(F.min(F.struct(-F.col("score"), "key")).alias("b"))
    return best.select(F.col("qid").alias(qid), F.col("owner").alias(owner), F.col("b.key").alias(key), (-F.col("b.col1")).alias("cosine"))
