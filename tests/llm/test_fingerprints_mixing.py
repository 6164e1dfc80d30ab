"""Syncmer fingerprints, source mixing, shard placement: against plain versions of the same rules."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import mixing, placement, syncmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sample(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 120))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_edited_texts_follow_descending_ids(spark, n):
    texts = sample(n, n)
    if n > 3:
        texts[2], texts[3] = None, ""
    rows = {r["doc_id"]: r for r in syncmers.edited_fingerprints(docs_of(spark, texts)).collect()}
    assert len(rows) == n
    order = sorted(range(n), reverse=True)
    for a, b in zip(order, order[1:] + order[:1]):
        own, other = texts[a] or "", texts[b] or ""
        k = len(own) // 3
        assert rows[a]["edited_sha256"] == hashlib.sha256((own[: len(own) - k] + other[:k]).encode()).hexdigest()
        assert rows[a]["n_chars"] == len(own) and 0 <= rows[a]["near_edited"] <= 1 and 0 <= rows[a]["near_next"] <= 1


def test_borders_between_buckets(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 3)
    texts = sample(5, 40)
    rows = spark.createDataFrame([(i * i * 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in syncmers.beside_next(rows).collect()}
    ids = sorted(got, reverse=True)
    by_id = {i * i * 7: t for i, t in enumerate(texts)}
    assert got == {a: by_id[b] for a, b in zip(ids, ids[1:] + ids[:1])}


def test_fingerprint_edges(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "", None, "one two", "x" * 5000, "a b c d e f g h i"]
    rows = {r["doc_id"]: r["fingerprint"] for r in syncmers.fingerprints(docs_of(spark, texts)).collect()}
    assert rows[0] == rows[1] and rows[2] == rows[3] == "" and len(rows[4]) == 8 and rows[5] and rows[0] != rows[6]


def test_repeated_ids_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d e"), (2, None)], "doc_id long, text string")
    assert syncmers.edited_fingerprints(rows).count() == 4
    assert syncmers.edited_fingerprints(rows.where("false")).count() == 0


def test_columns_of_clashing_names_stay_out(spark):
    rows = spark.createDataFrame([(i, t, "x", 5, 6) for i, t in enumerate(sample(2, 12))], "doc_id long, text string, sketch string, bucket int, next_text int")
    plain = rows.select("doc_id", "text")
    for made in (syncmers.edited_fingerprints, syncmers.fingerprints):
        assert sorted(map(tuple, made(rows).collect())) == sorted(map(tuple, made(plain).collect()))


def test_anchors_are_context_free(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = spark.createDataFrame([(1, "x y z " + passage), (2, passage + " q r s t")], "doc_id long, text string")
    found = defaultdict(dict)
    for r in syncmers.anchor_positions(rows).collect():
        found[r["doc_id"]][r["anchor"]] = r["position"]
    shared = set(found[1]) & set(found[2])
    assert len(shared) > 10 and {found[1][a] - found[2][a] for a in shared} == {3}
    inner = [a for a, p in found[2].items() if p <= 55]
    assert set(inner) <= set(found[1])


def test_anchors_of_texts_without_blanks_are_context_free(spark):
    rng = random.Random(9)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこさしすせそたちつてと日本語中文字", "ab9-/."):
        run = "".join(rng.choice(letters) for _ in range(2_000))
        rows = spark.createDataFrame([(1, run), (2, letters[0] + run), (3, run[:1000] + "!" + run[1000:])], "doc_id long, text string")
        found = defaultdict(set)
        for r in syncmers.anchor_positions(rows).collect():
            found[r["doc_id"]].add(r["anchor"])
        assert all(len(found[1] & found[k]) >= len(found[1]) - 6 for k in (2, 3)) and len(found[1]) > 20


def plain_anchors(text):
    kinds = [r"[^\x20\x09-\x0D]", "[A-Za-z]", "[0-9]"]
    words, n = [], 0
    while n < len(text):
        for kind in kinds:
            m = re.compile(f"{kind}+").match(text, n)
            before = n and re.fullmatch(kind, text[n - 1])
            if m and not before and len(m[0]) <= 16:
                words.append(m[0])
                n = m.end()
                break
        else:
            if re.fullmatch(kinds[0], text[n]):
                words.append(text[n])
            n += 1
    if len(words) < 5:
        return {spark_hash(" ".join(words)) & 0xFFFFFFFF} if words else set()
    tokens = [spark_hash(w) for w in words]
    found = set()
    for i in range(len(tokens) - 4):
        pairs = [spark_hash(tokens[j], tokens[j + 1]) for j in range(i, i + 4)]
        if min(pairs[0], pairs[3]) <= min(pairs[1:3]):
            found.add(spark_hash(pairs[0], pairs[3], min(pairs[1:3])) & 0xFFFFFFFF)
    return found


def test_fingerprints_match_a_plain_version(spark):
    rng = random.Random(4)
    texts = [*sample(6, 25), None, "", " ", "one two", "x" * 700, "http://www.example.com/a/b-c?d=1234567890123456789&e " * 9, "日本語" * 50, "w " * 5_000]
    texts += [" ".join(rng.choice(["a1b2", "straße", "longer-than-sixteen-characters-99", "ok."]) for _ in range(80)) for _ in range(5)]
    rows = {r["doc_id"]: r for r in syncmers.edited_fingerprints(docs_of(spark, texts)).collect()}

    def sketch(text):
        return sorted(plain_anchors(text))[: syncmers.SKETCH]

    def like(a, b):
        both = sorted({*a, *b})[: syncmers.SKETCH]
        return sum(x in a and x in b for x in both) / len(both) if both else 1.0

    order = sorted(range(len(texts)), reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        own, other = texts[i] or "", texts[j] or ""
        k = len(own) // 3
        a, b, c = sketch(own), sketch(own[: len(own) - k] + other[:k]), sketch(other)
        assert rows[i]["fingerprint"] == "".join(f"{x:08x}" for x in a) and rows[i]["edited_fingerprint"] == "".join(f"{x:08x}" for x in b)
        assert rows[i]["near_edited"] == pytest.approx(like(a, b)) and rows[i]["near_next"] == pytest.approx(like(a, c))


def goals(spark, sizes, weights):
    rows = [(f"s{i:03d}", n) for i, n in enumerate(sizes)]
    plan = mixing.planned(spark.createDataFrame(rows, "source string, size long"), weights, 1, 3)
    return [r["target"] for r in plan.orderBy("sid").collect()]


def test_targets_never_pass_the_limit(spark):
    assert goals(spark, [10, 10, 10], None) == pytest.approx([5.0, 10.0, 15.0])
    assert goals(spark, [100, 1, 1], [1, 2, 3]) == pytest.approx([96.0, 3.0, 3.0])
    assert goals(spark, [100, 5, 1, 4], [1, 1, 9, 9]) == pytest.approx([80.0, 15.0, 3.0, 12.0], abs=0.1) or sum(goals(spark, [100, 5, 1, 4], [1, 1, 9, 9])) == pytest.approx(110)
    assert goals(spark, [], None) == [] and goals(spark, [0, 0], [1, 2]) == [0.0, 0.0]


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100, 257):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long")).alias("p"))
        got = [r["p"] for r in rows.collect()]
        assert sorted(got) == list(range(n)) and (n < 50 or got != sorted(got))


@pytest.mark.parametrize("block", [1, 4, 64])
def test_mix_meets_its_targets(spark, block):
    texts = sample(3, 90) + [None, "", "   "]
    sources = {i: None if i % 5 == 4 else "hot" if i % 2 else f"s{i % 3}" for i in range(len(texts))}
    docs = docs_of(spark, texts, sources).withColumn("size", F.lit("clash"))
    rows = mixing.mix(docs, block_words=block).collect()
    again = mixing.mix(docs, block_words=block).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == len(texts)
    taken, goal, size = Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        s = sources[r["doc_id"]]
        taken[s] += r["taken"]
        size[s] += r["size"]
        goal[s] = r["target"]
    assert abs(sum(goal.values()) - sum(size.values())) < 1e-6
    assert all(abs(taken[s] - goal[s]) <= 2 * block and goal[s] <= 3 * size[s] + 1e-9 for s in goal)


def spark_hash(*values):
    """Spark's xxhash64 of text, long (int) and int (tuple of one) values; a null leaves the hash as it is."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, int) else struct.pack("<i", v[0])
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def permuted(at, n, key):
    for r in range(1, mixing.ROUNDS + 1):
        partner = (spark_hash(key, (r,)) % n - at) % n
        at = partner if spark_hash(key, (r,), max(at, partner)) & 1 else at
    return at


def plain_mix(sizes, sources, block_words, shard_slots):
    """taken and shards of every document by the rules of the module, one word at a time."""
    names = sorted({s for s in sources.values()}, key=lambda s: (s is None, s or ""))
    size = {s: sum(sizes[i] for i in sizes if sources[i] == s) for s in names}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    goal, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if 3 * size[s] < rate * weight[s]]
        if not over:
            goal |= {s: rate * weight[s] for s in open_}
            break
        goal |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        open_ -= set(over)
    blocks = {s: -(-size[s] // block_words) for s in names}
    count = {s: min(int(goal[s] * blocks[s] / size[s] + 0.5), 3 * blocks[s]) if size[s] else 0 for s in names}
    total = sum(count.values())
    shards = -(-total // shard_slots)
    deck = [sid for sid, s in enumerate(names) for _ in range(count[s])]
    drawn = [Counter(deck[permuted(i, total, "deck")] for i in range(k * shard_slots, min(total, (k + 1) * shard_slots))) for k in range(shards)]
    taken, of, buckets = Counter(), defaultdict(set), max(1, math.isqrt(len(sizes)))
    for sid, s in enumerate(names):
        ids = sorted((i for i in sizes if sources[i] == s), key=lambda i: (spark_hash("mix", i) % buckets, i))
        stream = [i for i in ids for _ in range(sizes[i])]
        for slot, shard in enumerate(k for k in range(shards) for _ in range(drawn[k][sid])):
            turn, n = slot // blocks[s], blocks[s]
            at = permuted(slot % n, n, spark_hash(sid, turn))
            for i in stream[at * block_words : (at + 1) * block_words]:
                taken[i] += 1
                of[i].add(shard)
    return taken, of, drawn


def test_mix_matches_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    texts = sample(8, 70)
    sources = {i: None if i % 7 == 6 else "hot" if i % 3 else f"s{i % 2}" for i in range(len(texts))}
    taken, of, drawn = plain_mix({i: len(t.split()) for i, t in enumerate(texts)}, sources, 4, 100)
    docs = docs_of(spark, texts, sources)
    rows = {r["doc_id"]: r for r in mixing.mix(docs, block_words=4).collect()}
    shards = len(drawn)
    assert shards > 5 and {i: r["taken"] for i, r in rows.items()} == {i: taken[i] for i in rows}
    assert {i: set(r["shards"]) for i, r in rows.items()} == {i: of[i] for i in rows}
    sized = docs.select("source", mixing.count_words(F.col("text")).alias("size"))
    counts = mixing.counts(mixing.planned(sized, None, 4, 3)).collect()
    assert {(r["shard"], r["sid"]): r["n"] for r in counts} == {(k, sid): n for k, own in enumerate(drawn) for sid, n in own.items()}
    assert [sum(own.values()) for own in drawn[:-1]] == [100] * (shards - 1)
    pieces = mixing.mix_documents(docs, block_words=4, shard="shard").collect()
    assert len({r["shard"] for r in pieces}) == shards
    assert all(set(WORD.findall(r["text"])) <= set(WORD.findall(texts[r["doc_id"]])) for r in pieces)


def test_the_draw_of_shards_is_multinomial(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 500)
    sized = spark.createDataFrame([("a", 20_000), ("b", 40_000), ("c", 30_000)], "source string, size long")
    counts = mixing.counts(mixing.planned(sized, None, 1, 3)).collect()
    whole = Counter()
    for r in counts:
        whole[r["shard"]] += r["n"]
    assert whole == {k: 500 for k in range(180)}
    for sid, total in ((0, 15_000), (1, 30_000), (2, 45_000)):
        n = [r["n"] for r in counts if r["sid"] == sid]
        mean, variance = total / 180, total / 180 * (1 - total / 90_000)
        assert sum(n) == total and len(n) == 180 and 0.7 * variance < sum((x - mean) ** 2 for x in n) / len(n) < 1.4 * variance


@pytest.mark.parametrize("few", [True, False])
def test_many_sources_draw_their_cards(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 7)
    monkeypatch.setattr(mixing, "CELLS", 5)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 10**6 if few else 0)
    sized = spark.createDataFrame([(f"s{i:03d}", i * i % 37) for i in range(150)], "source string, size long")
    plan = mixing.planned(sized, None, 1, 3)
    wanted = {r["sid"]: r["slots"] for r in plan.collect() if r["slots"]}
    drawn, whole = Counter(), Counter()
    for r in mixing.counts(plan).collect():
        drawn[r["sid"]] += r["n"]
        whole[r["shard"]] += r["n"]
    assert drawn == wanted and set(list(whole.values())) <= {64, sum(wanted.values()) % 64}
    assert mixing.slots(plan).count() == sum(wanted.values())


def test_mixed_documents_hold_the_words_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    texts = ["  a b\n\nc d  ", *sample(4, 40), None, "", "a b"]
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 3")).withColumn("tags", F.create_map(F.lit("k"), F.lit("v")))  # a repeated row
    rows = mixing.mix_documents(docs, block_words=4)
    assert rows.columns == docs.columns
    got = Counter()
    for r in rows.collect():
        words = WORD.findall(r["text"])
        got[r["doc_id"]] += len(words)
        assert set(words) <= set(WORD.findall(texts[r["doc_id"]]))
    total = sum(r["taken"] for r in mixing.mix(docs, block_words=4).collect())
    assert abs(sum(got.values()) - total) <= 16
    assert all(n <= 3 * len(WORD.findall(texts[i])) * (2 if i == 3 else 1) for i, n in got.items())
    empty = docs.where("false")
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_very_many_sources_and_a_very_long_text(spark):
    rows = spark.range(100_500).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    long = spark.createDataFrame([(-1, "w " * 300_000, "long")], "doc_id long, text string, source string")
    got = mixing.mix(rows.unionByName(long)).agg(F.count("*"), F.sum("taken"), F.sum("target"), F.max(F.col("taken") - 3 * F.col("size"))).first()
    assert got[0] == 100_501 and got[2] == pytest.approx(601_500) and got[3] <= 0


def test_lookup_table_is_even_and_steady():
    shards = [f"s{i}" for i in range(7)]
    table = placement.lookup_table(shards, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = placement.lookup_table(shards[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) / 1009 < 0.25
    heavy = Counter(placement.lookup_table(["a", "b"], 1009, {"b": 3}))
    assert 2.9 < heavy[1] / heavy[0] < 3.1
    for bad in ((shards, 1000), ([], 1009), (["a", "a"], 1009)):
        with pytest.raises(ValueError):
            placement.lookup_table(*bad)


def test_placement_matches_a_plain_version(spark):
    shards = ["a", "b", "c"]
    table = placement.lookup_table(shards)
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (10**12, "z")], "doc_id long, slot_ string")
    for r in placement.place(rows, shards).collect():
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % placement.SLOTS
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert placement.place(rows.where("false"), shards).count() == 0


def test_placement_of_clashing_columns_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, "mine", "x", 1, 2) for i in range(60)], "doc_id long, slot string, owner string, `row` int, `at` int")
    placed = placement.place(rows, ["a", "b", "c"])
    assert placed.columns == ["doc_id", "owner", "row", "at", "slot", "shard"]
    assert {(r["owner"], r["row"], r["at"]) for r in placed.collect()} == {("x", 1, 2)}
    placement.write_shards(rows, str(tmp_path / "out"), ["a", "b", "c"], files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == {(r["doc_id"], r["shard"]) for r in placed.collect()}


def test_lookup_table_matches_turns_taken_one_by_one():
    shards, slots = ["a", "b", "c", "d"], 101
    orders = []
    for s in shards:
        offset, step = placement.preference(s, slots)
        orders.append([(offset + k * step) % slots for k in range(slots)])
        assert sorted(orders[-1]) == list(range(slots))
    owner, turn = {}, 0
    while len(owner) < slots:
        owner[next(x for x in orders[turn % 4] if x not in owner)] = turn % 4
        turn += 1
    assert placement.lookup_table(shards, slots) == [owner[i] for i in range(slots)]
