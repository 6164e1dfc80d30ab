"""Centroid clustering and hard negatives: against SQL and plain versions, with odd rows."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import centroids, negatives, queries

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def by_sql(name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    out = con.execute(queries.oracle_sql()[name])
    return sorted(dict(zip([d[0] for d in out.description], r, strict=True)).items() for r in out.fetchall())


@pytest.mark.parametrize("name", ["op11_centroids", "op12_negatives"])
def test_queries_equal_their_sql(spark, name):
    got = [r.asDict() for r in queries.queries()[name](spark, SF).collect()]
    assert sorted(sorted(r.items()) for r in got) == sorted(sorted(r) for r in by_sql(name))


def vectors(seed, n, dims, spread=0.2):
    """Rows around a few centres, some of them equal."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, dims))
    found = (middle[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)
    found[:: 7] = found[0]
    return found.astype(float).tolist()


def plain_centroids(rows, dims, k, rounds, salt="2:"):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, _, v in sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v, v) for i, v in kept)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centres)]
    return sorted((i, n, d) for i, (d, n) in ((i, nearest(v)) for i, v in kept))


@pytest.mark.parametrize(("n", "dims", "k", "leaf"), [(300, 3, 9, 4), (120, 8, 40, 16), (30, 2, 40, 1)])
def test_clusters_equal_a_plain_version(spark, monkeypatch, n, dims, k, leaf):
    monkeypatch.setattr(centroids, "LEAF", leaf)
    monkeypatch.setattr(centroids, "CHUNK", 100)
    rows = list(enumerate(vectors(n, n, dims)))
    rows += [(n, None), (n + 1, [1.0] * (dims + 1)), (n + 2, [None] * dims), (n + 3, [NAN] * dims), (n + 4, [INF] * dims), (n + 5, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found, _ = centroids.cluster(frame, dims=dims, k=k, rounds=4)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == plain_centroids(rows, dims, k, 4)


def test_the_filter_assigns_whole_nodes(monkeypatch):
    rng = np.random.default_rng(1)
    points = np.rint(rng.normal(size=(5000, 4)) * 8 + rng.integers(0, 5, (5000, 1)) * 400).astype(np.int64)
    centres = np.array([[c * 400] * 4 for c in range(5)])
    tree, order = centroids.Tree.build(points)
    seen = sum(len(at) for _, at, _ in tree.parts(centres) if at is not None)
    assert seen < 500  # vectors looked at one by one
    owner, distance = tree.owners(centres)
    want = centroids.squared(points, centres)
    assert (owner == want.argmin(1)[order]).all() and (distance == want.min(1)[order]).all()


def test_ties_go_to_the_smaller_number_and_large_components_are_held(spark):
    tree, _ = centroids.Tree.build(np.zeros((10, 2), np.int64))
    assert tree.owners(np.array([[3, 0], [0, 3], [0, -3]]))[0].tolist() == [0] * 10
    rows = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0]), (None, [0.5, 0.5]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    found = centroids.centroid_report(rows, dims=2, k=3, rounds=2).collect()
    assert len(found) == 4 and {r["vec_id"] for r in found} == {1, 2, None}
    assert {r["inertia"] for r in found} == {sum(r["distance"] for r in found)}


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert centroids.centroid_report(empty).collect() == []
    assert negatives.hard_negatives(empty, F.col("key") % 100 == 0).collect() == []
    names = ["key", "vector", "row", "cluster", "distance", "codes", "keys", "rank", "n", "place", "_group"]
    rows = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vectors(2, 60, 4))], "vec_id long, embedding array<float>, label int")
    more = rows.withColumns({c: F.lit("x") for c in names})
    same = lambda f: sorted(map(repr, f(rows).collect())) == sorted(map(repr, f(more).collect()))
    assert same(lambda r: centroids.centroid_report(r, dims=4, k=5))
    assert same(lambda r: negatives.hard_negatives(r, F.col("key") % 10 == 0))


def plain_negatives(rows, anchor, low=30, high=90):
    """By all pairs; rows are told apart by their place in the list."""
    kept = [(n, i, [math.floor(256 * x) for x in v], lab) for n, (i, v, lab) in enumerate(rows)
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    found = []
    for n, i, v, lab in kept:
        if i is None or not anchor(i):
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=False)), j, other == lab) for m, j, w, other in kept if m != n]
        for s, j, _ in sorted((x for x in score if x[2]), key=key)[:5]:
            fits = sorted((x for x in score if not x[2] and low * s <= 100 * x[0] <= high * s), key=key)[:10]
            found += [(i, j, r + 1, x[1], s, x[0]) for r, x in enumerate(fits)]
    return sorted(map(repr, found))


@pytest.mark.parametrize(("n", "dims", "group"), [(200, 6, 30), (90, 3, 1000), (12, 1, 5)])
def test_negatives_equal_all_pairs(spark, monkeypatch, n, dims, group):
    monkeypatch.setattr(negatives, "GROUP_ROWS", group)
    monkeypatch.setattr(negatives, "WAVE", 3)
    monkeypatch.setattr(negatives, "BLOCK", 2)
    rng = random.Random(n)
    rows = [(i, v, rng.randrange(4)) for i, v in enumerate(vectors(n, n, dims, 0.6))]
    rows += [(1000, None, 1), (1010, [NAN] * dims, 1), (1020, [1.0] * dims, None), (1030, [None] * dims, 2), (1040, [], 1), (1050, [0.5] * (dims + 2), 1)]
    rows += [(None, [0.3] * dims, 1), (None, [0.3] * dims, 2), rows[10], rows[11]]  # null keys and repeated rows
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = negatives.hard_negatives(frame, F.col("key") % 10 == 0).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_bounds_hold_and_most_rows_are_passed_over():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(size=(3000, 16)) / 4).astype(np.int64)
    books = negatives.learn(rows[:1000])
    codes, residual = negatives.coded(rows, books)
    binary = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
    table = pa.table({"row": np.arange(3000), "key": np.arange(3000), "label": np.zeros(3000, np.int64), "vector": binary(rows.astype("<i4")), "codes": binary(codes), "residual": residual})
    side = negatives.Side(table, books)
    low, high = negatives.bounds(rows[:50], side, books)
    exact = rows[:50] @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    assert ((high >= negatives.floor_of(low, np.ones_like(low, bool), 5)[:, None]).mean()) < 0.1
