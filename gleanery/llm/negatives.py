"""Hard negatives: for each anchor and positive, the best rows of other labels within a window of scores.

Every component x becomes the integer floor(SCALE * x); a score is the integer inner product of two rows. Vectors are
stored with product-quantiser codes, one a subspace of SUB components, and the norm of what the codewords leave (the
residual). An anchor's lookup table holds its products with all codewords, so the sum of a row's entries and the anchor's
norm times the residual's bound its score from both sides. All arithmetic is in integers but for the norms, which are
rounded up, so the bounds hold without fail. Rows whose upper bound lies below the least score that is sure to be among
the wanted ones, or whose bounds lie outside a window, are passed over; the others get their exact score.

Anchors meet all rows in groups: rows are dealt by hash into groups of about GROUP_ROWS, anchors into waves of about
WAVE, and each group and wave is one task with bounded input, which yields its best rows alone; the best of those are
found by a window. One pass finds each anchor's positives, a second one, knowing their scores, completes the windows.
Codebooks are learned from SAMPLE rows at most, chosen by hash; every row is coded and no result depends on them.

Rows with a null label, a null vector, or a null or non-finite component take no part. Missing components of shorter
vectors count as 0; those of over 2**26 / SCALE in size count as that. Rows are told apart by a number of their own, so
repeated rows each count, also as positives of each other; ties go to the smaller key, null last, then to that number.
An empty table, or one without anchors, gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm.centroids import BOUND, SCALE, squared, whole_vectors
from gleanery.session import materialise

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Components of a subspace, its codewords, rows that they are learned from and rounds of learning.
SUB, WORDS, SAMPLE, LEARNING = 2, 256, 8_192, 4
#: Rows of a group, anchors of a wave and anchors that are looked up at once.
GROUP_ROWS, WAVE, BLOCK = 8_192, 4_096, 64


def padded(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of dims integers, shorter ones with zeros at their ends."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dims), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(np.floor(SCALE * flat), -BOUND, BOUND)
    return out


def learn(vectors: np.ndarray) -> np.ndarray:
    """Integer codewords of each subspace: subspaces x WORDS x SUB."""
    books = []
    for part in vectors.reshape(len(vectors), -1, SUB).swapaxes(0, 1):
        words = part[np.linspace(0, len(part) - 1, WORDS).astype(int)].astype(np.float64)
        for _ in range(LEARNING):
            owner = nearest(part, words)
            n = np.bincount(owner, minlength=WORDS)
            for i in range(SUB):
                words[:, i] = np.where(n > 0, np.bincount(owner, part[:, i], WORDS) / np.maximum(n, 1), words[:, i])
        books.append(np.rint(words).astype(np.int64))
    return np.array(books)


def nearest(part: np.ndarray, words: np.ndarray) -> np.ndarray:
    """About the nearest word of each row: any choice is right, a near one is better."""
    return ((words * words).sum(1) - 2.0 * (part.astype(np.float64) @ words.T)).argmin(1)


def coded(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of vectors and the norms of their residuals, rounded up."""
    parts = vectors.reshape(len(vectors), -1, SUB)
    codes = np.stack([nearest(parts[:, m], books[m].astype(np.float64)) for m in range(len(books))], axis=1)
    left = parts - books[np.arange(len(books)), codes]
    return codes.astype(np.uint8), norm_above((left * left).sum((1, 2)))


def norm_above(squares: np.ndarray) -> np.ndarray:
    return np.ceil(np.sqrt(squares.astype(np.float64)) * (1 + 1e-12))


def prepared(rows: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """row (a number of its own), key, label, vector, codes and residual (as bytes) of every row that takes part; their components."""
    rows = rows.select(rows[key].cast("long").alias("key"), rows[label].cast("long").alias("label"), rows[vector].cast("array<double>").alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & whole_vectors(rows, "vector"))
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    dims += -dims % SUB
    chosen = rows.select("vector", F.xxhash64("key", "vector").alias("mark")).orderBy("mark").limit(SAMPLE).select("vector").toArrow()
    sample = padded(chosen["vector"].combine_chunks(), dims) if chosen.num_rows else np.zeros((1, dims), np.int64)
    books = learn(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            vectors = padded(batch.column(2), dims)
            codes, residual = coded(vectors, books) if n else (np.zeros((0, len(books)), np.uint8), np.zeros(0))
            fixed = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + n)), batch.column(0), batch.column(1), fixed(vectors.astype("<i4")), fixed(codes), pa.array(residual)],
                ["row", "key", "label", "vector", "codes", "residual"])
            at += n

    found = rows.mapInArrow(run, "row long, key long, label long, vector binary, codes binary, residual double")
    return materialise(found, "negatives-rows"), books


class Side:
    """Columns of some rows as arrays."""

    def __init__(self, table: pa.Table, books: np.ndarray) -> None:
        subs, _, width = books.shape
        self.row, self.label = table["row"].to_numpy(), table["label"].to_numpy()
        self.key = table["key"].fill_null(np.iinfo(np.int64).max).to_numpy()
        self.keyless = table["key"].is_null().to_numpy()
        self.vector = np.frombuffer(b"".join(table["vector"].to_pylist()), "<i4").reshape(-1, subs * width).astype(np.int64)
        if "codes" in table.column_names:
            self.codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(-1, subs)
            self.residual = table["residual"].to_numpy()


def bounds(anchors: np.ndarray, rows: Side, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score that each row may have with each anchor, by lookup tables."""
    parts = anchors.reshape(len(anchors), -1, books.shape[2])
    tables = np.einsum("ams,mws->maw", parts, books)
    if np.abs(tables).max(axis=(1, 2), initial=0).sum() < 1 << 31:
        tables = tables.astype(np.int32)
    about = np.zeros((len(anchors), len(rows.codes)), tables.dtype)
    for m, table in enumerate(tables):
        about += table[:, rows.codes[:, m]]
    norms = norm_above((anchors * anchors).sum(1))
    slack = np.ceil(norms[:, None] * rows.residual * (1 + 1e-12)).astype(np.int64)
    return about - slack, about + slack


def best(order: tuple[np.ndarray, ...], group: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each group by some orders, the first of which counts most."""
    at = np.lexsort((*order[::-1], group))
    sorted_ = group[at]
    starts = np.flatnonzero(np.diff(sorted_, prepend=-1))
    rank = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
    return at[rank < n]


def floor_of(lower: np.ndarray, sure: np.ndarray, n: int) -> np.ndarray:
    """For each row of lower the n-th greatest of the sure ones: at least n scores reach it."""
    if lower.shape[1] < n:
        return np.full(len(lower), np.iinfo(np.int64).min)
    held = np.where(sure, lower, np.iinfo(np.int64).min)
    return np.partition(held, -n, axis=1)[:, -n]


def positives_in(anchors: Side, rows: Side, books: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Places of an anchor and a row, and their score: the n best of the anchor's label for each anchor."""
    for a in range(0, len(anchors.row), BLOCK):
        own = slice(a, a + BLOCK)
        low, high = bounds(anchors.vector[own], rows, books)
        same = (anchors.label[own, None] == rows.label) & (anchors.row[own, None] != rows.row)
        i, j = np.nonzero(same & (high >= floor_of(low, same, n)[:, None]))
        score = (anchors.vector[own][i] * rows.vector[j]).sum(1)
        first = best((-score, rows.keyless[j], rows.key[j], rows.row[j]), i, n)
        yield i[first] + a, j[first], score[first]


def negatives_in(anchors: Side, scores: list[list[int]], rows: Side, books: np.ndarray, n: int, low_pct: int, high_pct: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Places of an anchor, of one of its positives and of a row, and their score: the n best in the window of each positive."""
    most = max(map(len, scores), default=0)
    starts = np.array([[-(-low_pct * s // 100) for s in x] + [1] * (most - len(x)) for x in scores], np.int64).reshape(-1, most)
    ends = np.array([[high_pct * s // 100 for s in x] + [0] * (most - len(x)) for x in scores], np.int64).reshape(-1, most)
    for a in range(0, len(anchors.row), BLOCK):
        own = slice(a, a + BLOCK)
        low, high = bounds(anchors.vector[own], rows, books)
        other = anchors.label[own, None] != rows.label
        for p in range(most):
            first, last = starts[own, p, None], ends[own, p, None]
            sure = other & (low >= first) & (high <= last)
            maybe = other & (high >= np.maximum(first, floor_of(low, sure, n)[:, None])) & (low <= last)
            i, j = np.nonzero(maybe)
            score = (anchors.vector[own][i] * rows.vector[j]).sum(1)
            within = (score >= first[i, 0]) & (score <= last[i, 0])
            i, j, score = i[within], j[within], score[within]
            found = best((-score, rows.keyless[j], rows.key[j], rows.row[j]), i, n)
            yield i[found] + a, np.full(len(found), p), j[found], score[found]


def met(anchors: DataFrame, rows: DataFrame, groups: int, waves: int, run, schema: str) -> DataFrame:
    """What run(anchors, rows), on Arrow tables, gives of every wave of anchors and every group of rows."""
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, of: F.pmod(F.xxhash64(F.lit(of), "row"), F.lit(n)).cast("int")
    left = anchors.withColumn("_wave", dealt(waves, "wave")).withColumn("_group", all_(groups))
    right = rows.withColumn("_group", dealt(groups, "group")).withColumn("_wave", all_(waves))
    tasks = min(groups * waves, 10_000)
    both = (x.repartition(tasks, "_group", "_wave").groupBy("_group", "_wave") for x in (left, right))
    return next(both).cogroup(next(both)).applyInArrow(run, schema)


def best_rows(rows: DataFrame, by: list[str], n: int, key: str, row: str, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(key).asc_nulls_last(), row)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def hard_negatives(
    rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    anchors is a condition on the key, under the name key. An anchor's positives are the first others of its label; the
    negatives of both are the first rows of other labels whose score is from low to high per cent of the positive's.
    """
    rows, books = prepared(rows, key, vector, label)
    n = rows.count()
    chosen = rows.where(anchors)
    groups, waves = max(1, -(-n // GROUP_ROWS)), max(1, -(-chosen.count() // WAVE))

    def first_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_row", "key", "row", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        a, b = Side(left, books), Side(right, books)
        parts = list(positives_in(a, b, books, positives))
        i, j, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table([pa.array(a.row[i]), right["key"].take(pa.array(j)), pa.array(b.row[j]), pa.array(score)], names)

    found = met(chosen.select("row", "key", "label", "vector"), rows, groups, waves, first_pass, "anchor_row long, key long, row long, score long")
    found = best_rows(found, ["anchor_row"], positives, "key", "row", "rank")
    found = found.groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "key", "score"))).alias("found"))
    known = chosen.select("row", "key", "label", "vector").join(found, "row")
    known = materialise(known.select("row", "key", "label", "vector", F.col("found.key").alias("keys"), F.col("found.score").alias("scores")), "negatives-positives")

    def second_pass(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_row", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int32() if x == "place" else pa.int64()) for x in names], names)
        a, b = Side(left, books), Side(right, books)
        keys, scores = left["keys"].to_pylist(), left["scores"].to_pylist()
        parts = list(negatives_in(a, scores, b, books, negatives, low, high))
        i, p, j, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        pairs = list(zip(i.tolist(), p.tolist(), strict=True))
        columns = [pa.array(a.row[i]), left["key"].take(pa.array(i)), pa.array(p.astype(np.int32)), pa.array([keys[x][y] for x, y in pairs], pa.int64()),
                   pa.array([scores[x][y] for x, y in pairs], pa.int64()), right["key"].take(pa.array(j)), pa.array(b.row[j]), pa.array(score)]
        return pa.table(columns, names)

    schema = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_row long, score long"
    mined = met(known, rows, groups, waves, second_pass, schema)
    mined = best_rows(mined, ["anchor_row", "place"], negatives, "negative_id", "negative_row", "rank")
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
