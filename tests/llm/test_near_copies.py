"""Near copies against brute-force Jaccard, by kind of edit."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanery.llm import nearcopies, simhash


def jaccard(a, b, size=5):
    x, y = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a, b))
    return len(x & y) / len(x | y)


def edited(rng, words, kind, share):
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    n = max(1, round(share * len(words)))
    if kind == "appended":
        return words + new(n)
    if kind == "replaced":
        return words[:-n] + new(n)
    out = list(words)
    for i in rng.sample(range(len(words)), max(1, n // 5)):
        out[i] = new(1)[0]
    return out


@pytest.mark.parametrize("kind", ["appended", "replaced", "scattered"])
def test_pairs_stay_or_go_by_exact_similarity(spark, kind):
    rng = random.Random(kind)
    rows, expected = [], set()
    for k in range(120):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(100, 900))]
        copy = edited(rng, words, kind, rng.choice([0.05, 0.08, 0.1, 0.15, 0.2, 0.24, 0.3]))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        expected |= {2 * k} | ({2 * k + 1} if jaccard(words, copy) < 0.8 else set())
    assert 140 < len(expected) < 230
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == expected


def test_families_match_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    texts = [edited(rng, base, rng.choice(["appended", "replaced", "scattered"]), rng.uniform(0.02, 0.4)) for _ in range(150)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    expected = {min(k for k in range(len(texts)) if root[k] == r) for r in set(root)}
    assert 5 < len(expected) < 140
    kept = simhash.keep_one(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == expected


def test_wordless_and_short_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "two one"), (7, "a b c d e"), (8, "a b c d")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6, 7, 8]
    sizes = [len(x) for x in nearcopies.shingle_sets(["a b a b a b a", None, "a", "", "a b", "b a b"], 2)]
    assert sizes == [2, 0, 1, 0, 1, 2]


def brute_force(rows, similarity=0.8):
    """Component of every text by the exact similarity of all pairs that share a shingle."""
    def shingled(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    texts = sorted({t or "" for _, t in rows})
    sets, holders, root = [shingled(t) for t in texts], defaultdict(list), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    wordless = -1
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g])
        if not s:
            common, wordless = ({wordless: 0} if wordless >= 0 else {}), i
        for j, n in common.items():
            if not s or n / (len(s) + len(sets[j]) - n) >= similarity:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    place = {t: find(i) for i, t in enumerate(texts)}
    return {i: place[t or ""] for i, t in rows}


@pytest.mark.parametrize("large", [1024, 4])
def test_documents_match_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(nearcopies, "LARGE", large)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    least = {}
    for i, c in sorted(brute_force(rows).items()):
        least.setdefault(c, i)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    assert kept == sorted(least.values()) and len(kept) < len(rows)


def test_each_row_is_judged_by_its_own_text(spark):
    w, u = " ".join(f"w{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    schema = "doc_id long, text string, _kept_mark string, lang map<string,int>"
    rows = [(1, w, "a", None), (5, w, "a", None), (5, u, "a", None), (5, u, "a", None), (None, u, "b", None), (7, u, "c", None)]
    kept = sorted((r["doc_id"], r["text"][0]) for r in simhash.keep_one(spark.createDataFrame(rows, schema).select("doc_id", "text", "lang")).collect())
    assert kept == [(1, "w"), (5, "u")]
    lone = spark.createDataFrame([(None, w, "a", None), (None, w, "a", None)], schema).drop("_kept_mark")
    assert simhash.keep_one(lone).count() == 1
    assert simhash.keep_one(lone.where("false")).columns == ["doc_id", "text", "lang"]
    assert simhash.keep_one(lone.where("false")).count() == 0


def test_texts_that_share_a_hash_all_stay(spark, monkeypatch):
    monkeypatch.setattr(simhash, "text_hash", lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(16)))
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts, None, ""])]
    numbered = simhash.with_nodes(spark.createDataFrame(rows, "doc_id long, text string"), "text").collect()
    assert len({(r["node"], r["text"] or "") for r in numbered}) == len({r["node"] for r in numbered}) == 101 and len(numbered) == 202
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(100), 200]
