"""Points in spans against all pairs."""

import random

import pytest

from gleanery.operators import intervals


@pytest.mark.parametrize("reach", [1, 10, 10**6])
def test_all_spans_and_the_innermost(spark, reach):
    rng = random.Random(reach)
    spans = [(rng.choice("ab"), i, s := rng.randrange(-reach, reach), s + rng.choice([-1, 0, 1, rng.randrange(reach)])) for i in range(150)]
    spans += [spans[0], (None, 900, 0, 5), ("a", 901, None, 5)]
    points = [(rng.choice("abc"), rng.randrange(-reach, 2 * reach)) for _ in range(120)] + [("a", None), (None, 1)]
    s, p = spark.createDataFrame(spans, "k string, id int, start long, end long"), spark.createDataFrame(points, "k string, at long")
    inside = lambda q, x: q[0] == x[0] and q[0] and None not in (q[1], x[2]) and x[2] <= q[1] <= x[3]
    got = sorted(tuple(r) for r in intervals.containing(p, s, ["k"]).select("k", "at", "id").collect())
    assert got == sorted((q[0], q[1], x[1]) for q in points for x in spans if inside(q, x))
    best = {(r["k"], r["at"]): r["id"] for r in intervals.innermost(p, s, ["k"], ties=["id"]).collect()}
    assert best == {q: min((x[3] - x[2], -x[2], x[1]) for x in spans if inside(q, x))[2] for q in points if any(inside(q, x) for x in spans)}


def test_lines_and_symbols_meet_in_bins_only(spark):
    spans = spark.createDataFrame([(1, i, 100 * i, 100 * i + 30) for i in range(2_000)], "k int, id int, start long, end long")
    points = spark.createDataFrame([(1, 100 * i + 7) for i in range(2_000)], "k int, at long")
    found = intervals.containing(points, spans, ["k"])
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and found.count() == 2_000
    assert intervals.containing(points, spans.where("false"), ["k"]).count() == intervals.innermost(points.where("false"), spans, ["k"]).count() == 0
