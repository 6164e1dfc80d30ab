"""SimHash components and substring dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from gleanery.llm import components, simhash, substrings, syncmers

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text, size=4):
    words = WORD.findall((text or "").encode().translate(UPPER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, codes, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {ids[i]: min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))}


def varied(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 200))] for _ in range(6)]
    out = ["", None, "  \n", "One two", "one  TWO", "Ünï ÄB c d e"]
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_masks_cover_every_pair_within_the_radius(radius):
    found = [m % 2**64 for m in simhash.masks(radius)]
    rng = random.Random(radius)
    assert len(found) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        bits = sum(1 << p for p in rng.sample(range(64), radius))
        assert any(m & bits == 0 for m in found)
    inner = [m % 2**64 for m in simhash.masks(radius, 0xFFFF0000)]
    assert all(m & ~0xFFFF0000 == 0 for m in inner)


def test_components_match_brute_force(spark):
    texts = varied(1, 120)
    rows = spark.createDataFrame([(i * 3 + 5, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, code string")
    got = {r["doc_id"]: r for r in simhash.fingerprint_components(rows).collect()}
    codes = [plain_fingerprint(t) for t in texts]
    ids = [i * 3 + 5 for i in range(len(texts))]
    assert [got[i]["fingerprint"] for i in ids] == [f"{c:016x}" for c in codes]
    assert {i: got[i]["component_id"] for i in ids} == plain_components(ids, codes, 4)


@pytest.mark.parametrize("large", [2, 5, 4096])
def test_large_buckets_lose_no_link(spark, large):
    rng = random.Random(9)
    codes = [0]
    for _ in range(150):  # a chain of near codes, so that one component is wide
        codes.append(rng.choice(codes) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    codes = sorted(set(codes) | {rng.getrandbits(64) for _ in range(50)})
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    rows = spark.createDataFrame([(c, c, None) for c in signed], "node long, code long, seal binary")
    found = components.roots(simhash.links_within(rows, 4, None, large))
    root = {r["node"]: r["root"] for r in found.collect()}
    got = defaultdict(set)
    for c in signed:
        got[root.get(c, c)].add(c)
    expected = defaultdict(set)
    for c, r in plain_components(signed, codes, 4).items():
        expected[r].add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 20)} | {201: 200}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "zz yy xx ww vv uu")], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in simhash.fingerprint_components(rows).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, 4), (4, 4), (4, 4), (None, None)]))
    assert simhash.fingerprint_components(rows.where("false")).count() == 0
    assert simhash.keep_one(rows.where("false")).count() == 0


def test_very_long_texts_link_by_their_fingerprints(spark):
    words = [f"w{i * i % 7919}" for i in range(60_000)]
    changed = words[:100] + ["x"] + words[101:]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(f"v{i}" for i in range(60_000)))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.fingerprint_components(rows).collect()}
    assert got[2] == 1 and got[3] == 3


def test_keep_one_drops_copies_and_keeps_the_rest(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    half = base[:200] + [f"v{rng.randrange(5000)}" for _ in range(200)]
    other = [f"u{rng.randrange(5000)}" for _ in range(400)]
    rows = [(1, base), (2, near), (3, half), (4, other), (5, base)]
    docs = spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows], "doc_id long, text string, component_id string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 3, 4]


def plain_removal(rows, width=20):
    words = {i: WORD.findall((t or "").encode()) for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][s : s + width]), (i, s))
    out = {}
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (i, s):
                gone[s : s + width] = True
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def passages(seed, n):
    rng = random.Random(seed)
    shared = [[f"p{k}_{i}" for i in range(rng.randrange(15, 60))] for k in range(5)]
    out = [None, "", "a " * 50, "a b " * 40, "x y z\n" * 30, "a " * 21, "ä\tö " * 30, "b" * 3000, "c " + "long" * 900 + " d" * 25]
    for _ in range(n):
        words = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out + out[9:14]


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_matches_brute_force(spark, seed):
    texts = passages(seed, 80)
    order = list(range(len(texts)))
    random.Random(seed).shuffle(order)
    rows = [(i * 2, texts[i]) for i in order]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, start string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removal_digests(docs).collect()}
    assert got == plain_removal(rows)


def test_tiny_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MAX_CELLS", 1 << 10)
    rows = list(enumerate(passages(5, 60)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removal_digests(docs).collect()}
    assert got == plain_removal(rows)


def test_word_hashes_agree_with_words():
    text = "ab  cd\tabcdefgh abcdefghi\nab \x0bz" + "q" * 40
    hashes, starts = substrings.word_hashes(text.encode())
    words = WORD.findall(text.encode())
    assert [text.encode()[s : s + len(w)] for s, w in zip(starts, words)] == words and len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words)) and hashes[0] == hashes[4]


def test_repeated_rows_null_keys_and_texts_without_repeats(spark):
    long = " ".join(f"k{i}" for i in range(30))
    rows = spark.createDataFrame([(1, long, 0), (1, long, 0), (None, long + " tail", 0), (2, "short", 0)], "doc_id long, text string, n_chars long")
    got = [(r["doc_id"], r["n_removed"]) for r in substrings.removal_digests(rows).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, 0), (1, 0), (None, 30), (2, 0)]))
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substrings.without_repeats(rows).collect()}
    assert kept[None] == ("tail", 4) and kept[1] == (long, len(long)) and kept[2] == ("short", 5)
    assert substrings.removal_digests(rows.where("false")).count() == 0


@pytest.mark.parametrize("held", [1, 300, 10**9])
def test_what_a_task_holds_changes_no_row(spark, monkeypatch, held):
    monkeypatch.setattr(substrings, "MOST_HELD", held)
    monkeypatch.setattr(substrings, "slices", lambda batches, column, limit=0: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    rng = random.Random(6)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randrange(20, 60))] for _ in range(5)]
    texts = [" ".join(w for _ in range(4) for w in rng.choice([*passages, [f"w{rng.randrange(500)}" for _ in range(30)]])) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        words, gone = t.split(), set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone |= set(range(k, k + 20))
            seen.add(window)
        expected[i] = (len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in substrings.removal_digests(rows).collect()} == expected


def test_other_blanks_are_words_and_keys_are_numbers(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = spark.createDataFrame([(1, passage, 0), (2, passage + " \u3000 \u00a0x", 0)], "doc_id long, text string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in substrings.without_repeats(rows).collect()}[2] == "\u3000 \u00a0x"
    named = rows.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text", "n_chars")
    for made in (substrings.removal_digests, syncmers.edited_fingerprints):
        with pytest.raises(ValueError):
            made(named)
