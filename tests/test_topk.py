"""The best documents by blocks of postings: the rows of the plain way, and how few blocks they take."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import lexical, topk


def corpus(spark, seed, n, vocabulary):
    rng = random.Random(seed)
    word = lambda: f"w{int(vocabulary * rng.random() ** 3)}"  # noqa: E731  a few words are very common
    docs = [(i, [word() for _ in range(rng.randrange(0, 60))]) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(20)]  # ties
    queries = [(q, sorted({word() for _ in range(rng.randrange(1, 15))} | {"w0", "absent"})) for q in range(30)] + [(30, ["absent"])]
    frame = spark.createDataFrame(docs, "k long, words array<string>")
    terms = spark.createDataFrame([(q, t) for q, ts in queries for t in ts], "qid long, term string")
    return lexical.index(frame, "k", F.col("words")), terms


def best(found, k):
    rows = lexical.top(found.withColumn("score", F.round("score", 6)), k, [F.desc("score"), F.asc("k")])
    return sorted((r["qid"], r["rank"], r["k"], r["score"]) for r in rows.collect())


@pytest.mark.parametrize(("k", "bucket"), [(1, 8), (10, 8), (10, 1_000), (5_000, 50)])
def test_the_same_documents_as_by_all_postings(spark, monkeypatch, k, bucket):
    monkeypatch.setattr(topk, "BUCKET_DOCS", bucket)
    monkeypatch.setattr(topk, "SEED_DOCS", 2)
    ix, terms = corpus(spark, k, 900, 400)
    weights = lexical.weigh(ix, terms)
    found, _ = topk.top_k(topk.blocks(ix), weights, k)
    assert best(found, k) == best(lexical.score(ix, weights), k)


def test_most_blocks_are_never_read(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_DOCS", 16)
    monkeypatch.setattr(topk, "SEED_DOCS", 2)
    ix, _ = corpus(spark, 3, 2_000, 3_000)
    rare = [r["term"] for r in ix.frequencies.where("df BETWEEN 3 AND 6").orderBy("term").limit(40).collect()]
    common = [r["term"] for r in ix.frequencies.orderBy(F.desc("df")).limit(4).collect()]
    terms = spark.createDataFrame([(q, t) for q in range(10) for t in rare[4 * q : 4 * q + 4] + common], "qid long, term string")
    weights, known = lexical.weigh(ix, terms), topk.blocks(ix)
    found, read = topk.top_k(known, weights, 2)
    assert best(found, 2) == best(lexical.score(ix, weights), 2)
    every = known.table.join(terms, "term").count()
    assert read.distinct().count() == read.count() < 0.35 * every


def test_no_documents_and_no_known_terms(spark):
    ix, terms = corpus(spark, 1, 50, 40)
    none = topk.blocks(lexical.index(spark.createDataFrame([], "k long, words array<string>"), "k", F.col("words")))
    weights = lexical.weigh(ix, terms)
    assert topk.top_k(none, weights, 3)[0].count() == 0
    assert topk.top_k(topk.blocks(ix), weights.where("qid = 30"), 3)[0].count() == 0


def test_rows_of_one_key_are_one_document(spark):
    docs = [(1, ["a", "b"]), (1, ["a", "c", "c"]), (2, ["a"]), (1, []), (3, []), (4, ["c"])]
    ix = lexical.index(spark.createDataFrame(docs, "k long, words array<string>").repartition(3), "k", F.col("words"))
    terms = spark.createDataFrame([(0, "a"), (0, "c"), (1, "b")], "qid long, term string")
    weights = lexical.weigh(ix, terms)
    plain = lexical.score(dataclasses.replace(ix, whole=None), weights)
    rows = lambda found: sorted((r["qid"], r["k"], round(r["score"], 9), *r[3:5]) for r in found.select("qid", "k", "score", "matched", F.round("mass", 9)).collect())
    assert rows(lexical.score(ix, weights)) == rows(plain)
    for k in (1, 2):
        assert best(lexical.score(ix, weights, k), k) == best(topk.top_k(topk.blocks(ix), weights, k)[0], k) == best(plain, k)


@pytest.mark.parametrize(("pairs", "cells"), [(1 << 20, 1 << 21), (7, 100), (1, 1)])
def test_documents_are_scored_where_they_lie(spark, monkeypatch, pairs, cells):
    """scores come without a shuffle or a hash table of all pairs of a query and a document."""
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    monkeypatch.setattr(lexical, "CELLS", cells)
    ix, terms = corpus(spark, 9, 300, 200)
    weights = lexical.weigh(ix, terms)
    whole, plain = lexical.score(ix, weights), lexical.score(dataclasses.replace(ix, whole=None), weights)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    rows = lambda found: sorted((r["qid"], r["k"], round(r["score"], 6), r["matched"], round(r["mass"], 6)) for r in found.collect())
    assert rows(whole) == rows(plain)
    few = lexical.score(ix, weights, 3)
    assert best(few, 3) == best(plain, 3) and few.columns == ["qid", "k", "score"]
    assert pairs < 8 or few.count() < plain.count()


def test_blocks_are_made_without_a_shuffle(spark):
    """a term's postings were brought together from all tasks."""
    ix, _ = corpus(spark, 2, 400, 100)
    seen = []
    whole = topk.materialise
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(topk, "materialise", lambda df, label: (seen.append((label, df._jdf.queryExecution().executedPlan().toString())), whole(df, label))[1])
        known = topk.blocks(ix)
    assert [label for label, plan in seen if "Exchange" in plan] == ["block-terms"]
    got = {(r["term"], r["p"]["key"]) for r in known.table.select("term", F.explode("posts").alias("p")).collect()}
    assert got == {(r["term"], r["k"]) for r in ix.postings.collect()} and len(got) == ix.postings.count()
