"""Centroid clustering in exact integers, by kd-tree filtering.

Every component x becomes the integer floor(SCALE * x). Each task builds kd-trees over its vectors, CHUNK of them in one
tree: a node holds the count, the integer sums and the box of its vectors. A round goes down the trees: in a node, the
centroid nearest to the middle of the box beats every other that is strictly farther at the corner of the box that
favours it most; those are out for the whole node. A node with one centroid left goes to it whole, by its count and sums,
and its vectors aren't looked at; a leaf with several is resolved by exact distances, ties to the smaller number. Only
sums for each centroid leave a task. The trees are written once and read again in each round.

Vectors with another number of components than dims, or with a null or non-finite one, and null vectors are left out.
A component of over 2**26 / SCALE in size counts as that, so that squared distances fit a long. Repeated rows each
count; equal vectors go to one centroid. Rows with a null key are clustered like others and come last in the choice of
the first centroids; of rows with one key there the lesser vector comes first. Fewer rows than centroids give fewer
centroids, an empty table an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.mixing import literal
from gleanery.session import materialise, release

SCALE, DIMS, CENTROIDS, ROUNDS = 256, 64, 40, 5
#: Vectors of a tree, of a leaf at most, and bytes of vectors in a tree at most.
CHUNK, LEAF, CHUNK_BYTES = 8_192, 64, 16 << 20
#: Components are held within this, and up to EXACT_FLOAT sums of their squares are exact in doubles.
BOUND, EXACT_FLOAT = 1 << 26, 1 << 21


def whole_vectors(rows: DataFrame, vector: str) -> Column:
    """Whether a row's vector is there, with neither null nor non-finite components."""
    return F.coalesce(~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors of dims components each as rows of integers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.clip(np.floor(SCALE * flat), -BOUND, BOUND).astype(np.int64)


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centres."""
    if max(np.abs(points).max(initial=0), np.abs(centres).max(initial=0)) <= EXACT_FLOAT and points.shape[1] <= 512:
        p, c = points.astype(np.float64), centres.astype(np.float64)
        return ((p * p).sum(1)[:, None] + (c * c).sum(1) - 2 * (p @ c.T)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centres], axis=1)


class Tree:
    """Nodes over vectors in tree order: first and last vector of each, its children (0: leaf), box and sums."""

    def __init__(self, vectors: np.ndarray, spans: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> None:
        self.vectors, self.spans, self.low, self.high, self.sums = vectors, spans, low, high, sums

    @staticmethod
    def build(vectors: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of some vectors and their order in it. A node is halved at the median of its widest side."""
        order = np.arange(len(vectors))
        spans, boxes = [[0, len(vectors), 0]], []
        while len(boxes) < len(spans):
            at = len(boxes)
            a, b, _ = spans[at]
            own = vectors[order[a:b]]
            low, high = own.min(0), own.max(0)
            boxes.append((low, high, own.sum(0)))
            side = int((high - low).argmax())
            if b - a > LEAF and high[side] > low[side]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, side], half)]
                spans[at][2] = len(spans)
                spans += [[a, a + half, 0], [a + half, b, 0]]
        low, high, sums = (np.array(x) for x in zip(*boxes, strict=True))
        return Tree(vectors[order], np.array(spans), low, high, sums), order

    def filtered(self, centres: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes and the centroids left to each (a mask): one if the node goes whole, else the node is a leaf."""
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(centres)), bool)
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            away = np.where(left, squared(low + high, 2 * centres), np.iinfo(np.int64).max)
            best = centres[away.argmin(1)]
            step = centres[None] - best[:, None]
            corner = np.where(step > 0, high[:, None], low[:, None])
            farther = (step * (centres[None] + best[:, None] - 2 * corner)).sum(-1)
            left &= farther <= 0  # strictly dominated ones go
            child = self.spans[nodes, 2]
            done = (left.sum(1) == 1) | (child == 0)
            if done.any():
                yield nodes[done], left[done]
            nodes, left = np.concatenate([child[~done], child[~done] + 1]), np.concatenate([left[~done]] * 2)

    def parts(self, centres: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
        """What the filter leaves: (nodes, None, their centroids), or (nodes, places of their vectors, the vectors' centroids)."""
        for nodes, left in self.filtered(centres):
            whole = left.sum(1) == 1
            if whole.any():
                yield nodes[whole], None, left[whole].argmax(1)
            if not whole.all():
                open_, some = nodes[~whole], np.flatnonzero(left[~whole].any(0))
                at = np.concatenate([np.arange(a, b) for a, b in self.spans[open_, :2]])
                yield open_, at, some[squared(self.vectors[at], centres[some]).argmin(1)]

    def sums_by(self, centres: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add the counts and sums of the vectors of each centroid."""
        for nodes, at, owner in self.parts(centres):
            np.add.at(counts, owner, 1 if at is not None else self.spans[nodes, 1] - self.spans[nodes, 0])
            np.add.at(sums, owner, self.vectors[at] if at is not None else self.sums[nodes])

    def owners(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each vector and its squared distance."""
        owner = np.zeros(len(self.vectors), np.int64)
        for nodes, at, found in self.parts(centres):
            if at is not None:
                owner[at] = found
            else:
                for (a, b), one in zip(self.spans[nodes, :2], found, strict=True):
                    owner[a:b] = one
        return owner, ((self.vectors - centres[owner]) ** 2).sum(1)

    def stored(self) -> list[bytes]:
        return [np.ascontiguousarray(x, kind).tobytes() for x, kind in ((self.vectors, "<i4"), (self.spans, "<i4"), (self.low, "<i4"), (self.high, "<i4"), (self.sums, "<i8"))]

    @staticmethod
    def read(stored: list[bytes], dims: int) -> Tree:
        kinds, widths = ("<i4", "<i4", "<i4", "<i4", "<i8"), (dims, 3, dims, dims, dims)
        return Tree(*(np.frombuffer(x, k).astype(np.int64).reshape(-1, w) for x, k, w in zip(stored, kinds, widths, strict=True)))


FIELDS = ["vectors", "spans", "low", "high", "sums"]


def trees_of(rows: DataFrame, dims: int) -> DataFrame:
    """Trees over the rows (key, vector) of each task: keys (in tree order) and the tree's parts."""
    kind = rows.schema["key"].dataType.simpleString()
    most = max(LEAF, min(CHUNK, CHUNK_BYTES // (8 * dims)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tree() -> pa.RecordBatch:
            both = pa.Table.from_batches(held).combine_chunks()
            built, order = Tree.build(integers(both["vector"].chunk(0), dims))
            keys = both["key"].chunk(0).take(pa.array(order))
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([lists, *(pa.array([x], pa.binary()) for x in built.stored())], ["keys", *FIELDS])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                room = most - sum(x.num_rows for x in held)
                held.append(batch.slice(at, room))
                at += held[-1].num_rows
                if held[-1].num_rows == room:
                    yield tree()
                    held = []
        if held:
            yield tree()

    return rows.mapInArrow(run, f"keys array<{kind}>, {', '.join(f'{x} binary' for x in FIELDS)}")


def read_trees(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, Tree]]:
    for i in range(batch.num_rows):
        yield i, Tree.read([batch.column(batch.schema.get_field_index(x))[i].as_py() for x in FIELDS], dims)


def moved(trees: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of each one's vectors; those without any stay."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, tree in read_trees(batch, dims):
                tree.sums_by(centres, counts, sums)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * dims, pa.int32()), pa.array(sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(counts), lists], ["cluster", "n", "sums"])

    parts = trees.select(*FIELDS).mapInArrow(run, "cluster int, n long, sums array<long>").where("n > 0")
    sums = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    found = centres.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # one row for each centroid
        found[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dims)]
    return found


def first_centroids(rows: DataFrame, k: int, salt: str, dims: int) -> np.ndarray:
    """The vectors of the k rows (key, vector) with the smallest SHA-256 of salt and key, in that order."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")), 256)
    chosen = rows.select(mark.alias("mark"), "vector").orderBy(F.col("mark").asc_nulls_last(), "vector").limit(k).collect()
    values = pa.array([list(r["vector"]) for r in chosen], pa.list_(pa.float64()))
    return integers(values, dims) if len(chosen) else np.zeros((0, dims), np.int64)


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
    dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "2:",
) -> tuple[DataFrame, np.ndarray]:
    """key, cluster and distance (squared, to its centroid) of every vector kept, and the centroids."""
    rows = vectors.select(vectors[key].alias("key"), vectors[vector].cast("array<double>").alias("vector"))
    rows = rows.where((F.size("vector") == dims) & whole_vectors(rows, "vector"))
    centres = first_centroids(rows, k, salt, dims)
    trees = materialise(trees_of(rows, dims), "centroid-trees")
    for _ in range(rounds if len(centres) else 0):
        centres = moved(trees, centres)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tree in read_trees(batch, dims):
                owner, distance = tree.owners(centres)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(owner.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    found = materialise(trees.mapInArrow(run, f"key {kind}, cluster int, distance long"), "centroid-owners")
    release(trees)
    return found.withColumnRenamed("key", key), centres


def centroid_report(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept.

    A sum of distances that doesn't fit a long is null.
    """
    found, centres = cluster(vectors, key, vector, **options)
    held = {r["cluster"]: int(r["n"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    sums = literal([fits(held.get(i, 0)) for i in range(len(centres))], "bigint")
    marks = literal([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres], "string")
    return found.withColumns({
        "cluster_inertia": F.get(sums, F.col("cluster")),
        "inertia": F.lit(fits(sum(held.values()))).cast("long"),
        "centroid_sha256": F.get(marks, F.col("cluster")),
    })
