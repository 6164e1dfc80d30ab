"""Many patterns at once against a look at every pair."""

import random

import pytest

from gleanery.operators import grams, links


def case(spark, seed, n_texts, n_patterns):
    rng = random.Random(seed)
    letters = "ab cÉ日\U0001f600\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 80))) for _ in range(n_texts)] + [None, "", "aaaaaa", "日" * 20]
    whole = "".join(t or "" for t in texts)
    cut = lambda: (i := rng.randrange(len(whole)), whole[i : i + rng.choice([1, 1, 2, 2, 3, 4, 5, 9, 30])])[1]
    patterns = [cut() for _ in range(n_patterns - 6)] + ["", None, "aaa", "zzz", "日日", "absent pattern"]
    expected = sorted((k, i) for i, q in enumerate(patterns) for k, t in enumerate(texts) if q and t is not None and q in t)
    return (spark.createDataFrame([(k // 10, k % 10, t) for k, t in enumerate(texts)], "a int, b int, text string").repartition(3),
            spark.createDataFrame(list(enumerate(patterns)), "qid long, q string"), expected)


@pytest.mark.parametrize(("few", "patterns"), [(32, 20), (0, 20), (32, 400)])
def test_texts_that_hold_patterns(spark, few, patterns):
    texts, asked, expected = case(spark, patterns, 120, patterns)
    found = grams.holding(texts, ["a", "b"], "text", asked, few=few)
    assert found.columns == ["a", "b", "text", "qid", "q"] and dict(found.dtypes)["qid"] == "bigint"
    assert sorted((r["a"] * 10 + r["b"], r["qid"]) for r in found.collect()) == expected


def test_thousands_of_patterns_meet_in_equi_joins(spark):
    words = [f"w{i * i % 100_003:05d}" for i in range(6_000)]
    texts = spark.createDataFrame([(k, " ".join(words[k * 12 : k * 12 + 24])) for k in range(480)], "k int, text string")
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(words[:3_000])], "qid int, q string")
    found = grams.holding(texts, ["k"], "text", asked)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = {(r["k"], r["qid"]) for r in found.collect()}
    assert got == {(k, i) for k in range(480) for i, w in enumerate(words[:3_000]) if k * 12 <= i < k * 12 + 24 or w in words[k * 12 : k * 12 + 24]}


def test_no_texts_or_no_patterns(spark):
    texts, asked, _ = case(spark, 1, 50, 50)
    for few in (0, 32):
        assert grams.holding(texts.where("false"), ["a", "b"], "text", asked, few=few).count() == 0
        assert grams.holding(texts, ["a", "b"], "text", asked.where("false"), few=few).count() == 0


def test_context_and_names(spark):
    lines = spark.createDataFrame([("n.md", i, f"Line {i % 3} of {i}") for i in range(1, 100)], "path string, line long, text string")
    asked = spark.createDataFrame([(0, "LINE 1"), (1, "of 5"), (2, "")], "qid int, q string")
    rows = links.context_search(lines, asked).collect()
    assert {r["qid"] for r in rows} == {0, 1} and [r["line"] for r in rows if r["qid"] == 0] == list(range(1, 60, 3))
    assert {r["note_matches"] for r in rows if r["qid"] == 0} == {33} and {r["note_matches"] for r in rows if r["qid"] == 1} == {11}
    notes = spark.createDataFrame([("a/Bcd.md",), ("bcd/x.md",), ("x/abcde.md",)], "path string")
    named = links.search_names(notes, spark.createDataFrame([(7, "BCD"), (8, "md")], "qid int, q string"))
    assert sorted((r["qid"], r["path"]) for r in named.collect()) == [(7, "a/Bcd.md"), (7, "x/abcde.md")]


@pytest.mark.parametrize("few", [0, 32])
def test_equal_patterns_are_looked_for_once(spark, few, monkeypatch):
    texts = spark.createDataFrame([(0, "abc"), (1, "xabcx"), (2, "xyz")], "k int, text string")
    asked = spark.createDataFrame([(i, ("abc", "xyz")[i % 2]) for i in range(500)], "qid int, q string")
    seen = []
    for name in ("rarest", "one_by_one"):
        whole = getattr(grams, name)
        monkeypatch.setattr(grams, name, lambda *a, whole=whole, at={"rarest": 2, "one_by_one": 2}[name]: (seen.append(a[at] if isinstance(a[at], list) else a[at].collect()), whole(*a))[1])
    got = {(r["k"], r["qid"]) for r in grams.holding(texts, ["k"], "text", asked, few=few).collect()}
    assert got == {(k, i) for i in range(500) for k in ((0, 1), (2,))[i % 2]} and [len(x) for x in seen] == [2]


def test_names_for_many_that_ask_the_same(spark):
    notes = spark.createDataFrame([(f"a/{i}.md",) for i in range(200)], "path string")
    asked = spark.createDataFrame([(i, str(i % 3)) for i in range(1, 301)], "qid int, q string")
    rows = links.search_names_once(notes, asked).collect()
    assert sorted((r["qid"], r["same_as"]) for r in rows if r["path"] is None) == [(i, i % 3 or 3) for i in range(1, 301)]
    assert sorted((r["same_as"], r["path"]) for r in rows if r["path"]) == sorted((i, f"a/{n}.md") for i in (1, 2, 3) for n in range(200) if str(i % 3) in str(n))
    assert {r["qid"] for r in rows if r["path"]} == {1, 2, 3}


@pytest.mark.parametrize(("pairs", "patterns"), [(1 << 20, 400), (5, 60)])
def test_patterns_by_joins_and_within_tasks(spark, monkeypatch, pairs, patterns):
    monkeypatch.setattr(grams, "PAIRS", pairs)
    texts, asked, expected = case(spark, patterns + 1, 120, patterns)
    for sent in (0, grams.SENT):
        found = grams.holding(texts, ["a", "b"], "text", asked, few=0, sent=sent)
        assert sorted((r["a"] * 10 + r["b"], r["qid"]) for r in found.collect()) == expected


def test_neither_texts_nor_grams_are_shuffled(spark):
    """a row for each place of an asked gram went over the network, and the texts to meet what was left."""
    texts = spark.range(300).selectExpr("id AS k", "concat_ws(' ', id, id * 7, id % 10, 'a common end') AS text")
    asked = spark.range(200).selectExpr("id AS qid", "concat(id * 7, ' ', id % 10) AS q")
    found = grams.holding(texts, ["k"], "text", asked)
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "at#" not in plan
    got = {(r["k"], r["qid"]) for r in found.collect()}
    assert got == {(k, i) for k in range(300) for i in range(200) if f"{i * 7} {i % 10}" in f"{k} {k * 7} {k % 10} a common end"}
