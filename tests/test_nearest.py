"""Exact nearest vectors against all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.operators import nearest


def rows_of(seed, n, dims, spread, clusters=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, dims))
    found = middle[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dims))
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    found[::5] = found[0]  # many equal ones
    return found.astype(np.float32)


def plain(rows, queries, k):
    found = {}
    for q, w in queries:
        scored = sorted((-math.floor(float(np.dot(np.pad(np.float64(v), (0, len(w) - len(v))), np.float64(w))) * 1e6 + 0.5) / 1e6, i) for i, v in rows if v is not None)
        found[q] = [(i, n + 1, -s) for n, (s, i) in enumerate(scored[:k])]
    return found


def frames(spark, rows, queries):
    make = lambda pairs, names: spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in pairs], names)
    return make(rows, "vec_id long, embedding array<float>").repartition(3), make(queries, "qid long, query_vector array<float>")


@pytest.mark.parametrize(("spread", "group_rows", "waves"), [(0.1, 40, 3), (1.0, 40, 2_048), (0.3, 10_000, 2_048)])
def test_the_same_rows_as_all_pairs(spark, monkeypatch, spread, group_rows, waves):
    monkeypatch.setattr(nearest, "WAVE", waves)
    vectors = rows_of(1, 600, 8, spread)
    rows = [*enumerate(vectors), (600, None), (601, [0.0] * 8), (602, list(vectors[3] * 2)), (603, list(vectors[4][:5]))]
    queries = [*enumerate(vectors[:20] * 1.5), (20, [0.0] * 8)]
    got = {}
    for r in nearest.nearest(*frames(spark, rows, queries), 7, group_rows=group_rows).collect():
        got.setdefault(r["qid"], []).append((r["vec_id"], r["rank"], r["cosine"]))
    want = plain(rows, queries, 7)
    assert {q: sorted(x, key=lambda t: t[1]) for q, x in got.items()} == {q: [(i, n, pytest.approx(s, abs=2e-6)) for i, n, s in x] for q, x in want.items()}


def test_queries_are_sent_only_where_they_can_win(spark):
    rng = np.random.default_rng(4)
    vectors = rows_of(3, 2_000, 6, 0.02, 30)
    rows, queries = frames(spark, list(enumerate(vectors)), list(enumerate(vectors[rng.integers(0, 2_000, 60)])))
    assert nearest.share_computed(rows, queries, 5, group_rows=60) < 0.4
    assert nearest.share_computed(rows, queries, 5, group_rows=10_000, pivots=1) == 1.0


def test_owners_and_empty_tables(spark):
    vectors = rows_of(5, 100, 4, 0.5)
    rows, queries = frames(spark, list(enumerate(vectors)), list(enumerate(vectors[:6])))
    owned = rows.withColumn("owner", F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 3).cast("string"))
    got = {(r["qid"], r["owner"]): (r["vec_id"], r["cosine"]) for r in nearest.best_per_owner(owned, queries, "owner").collect()}
    for q in range(6):
        for o in (None, "1", "2"):
            own = [(i, v) for i, v in enumerate(vectors) if (str(i % 3) if i % 3 else None) == o]
            i, _, s = plain(own, [(q, vectors[q])], 1)[q][0]
            assert got[q, o] == (i, pytest.approx(s, abs=2e-6))
    assert len(got) == 18
    for a, b in ((rows.where("false"), queries), (rows, queries.where("false"))):
        assert nearest.nearest(a, b, 3).count() == 0 and nearest.best_per_owner(a.withColumn("owner", F.lit(1)), b, "owner").count() == 0


def test_a_task_holds_few_products_at_a_time():
    rng = np.random.default_rng(3)
    rows, queries = rng.normal(size=(4_096, 16)), rng.normal(size=(2_048, 16))
    seen = []

    def choose(scores, keys, owners, k):
        seen.append(scores.size)
        return nearest.first_k(scores, keys, owners, k)

    some = pa.table({"qid": pa.array(range(2_048)), "query": pa.array(list(queries))})
    held = pa.table({"key": pa.array(range(4_096)), "owner": pa.nulls(4_096, pa.int32()), "vector": pa.array(list(rows))})
    found = nearest.products(some, held, 16, 3, choose)
    scores = np.floor(queries @ rows.T * 1e6 + 0.5) / 1e6
    expected = [(q, r) for q in range(2_048) for r in np.lexsort((np.arange(4_096), -scores[q]))[:3]]
    assert list(zip(found["qid"].to_pylist(), found["key"].to_pylist(), strict=True)) == expected
    assert max(seen) <= nearest.MOST_SCORES and sum(found["pairs"].to_pylist()) == scores.size
