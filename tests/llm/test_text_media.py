"""Language, quality, audio, URLs and BPE: held-out accuracy, round trips, the public library."""

import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import bpe, language, media, quality, queries, urls

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_language_is_right_on_held_out_documents(spark, docs):
    rows = queries.op2_language(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang_pred"] == r["lang"] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_mixtures_and_unknown_texts(spark, docs):
    model = language.learn(docs)
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 3000").dropDuplicates(["lang"]).collect()}
    name, score, found, _ = model.judge(by["en"][:1500] + " " + by["fr"][:3000])
    assert name == "fr" and 0.5 < score < 0.85 and {x for x, _ in found} == {"en", "fr"}
    assert [len(model.judge(t)[2]) for t in by.values()] == [1] * len(by)
    assert model.judge(None)[:2] == model.judge("")[:2] == model.judge("123 !!")[:2] == ("und", 0.0)
    assert model.judge("A.")[0] in model.names
    rows = spark.createDataFrame([(1, None), (1, "x" * 10**6), (None, "the of and")], "doc_id long, text string")
    assert language.identify(rows, model).count() == 3 and language.identify(rows.where("false"), model).count() == 0
    nothing = language.learn(docs.where("false"))
    assert nothing.judge("the of")[:2] == ("und", 0.0)


def learned(words_of):
    """A model of invented languages, each from a list of words."""
    counts = np.stack([np.bincount(language.grams(" ".join(w)), minlength=language.BUCKETS) for w in words_of.values()], axis=1)
    return language.Mixture(list(words_of), counts.astype(float))


def invented(rng, letters, n=400):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_a_second_language_behind_ten_dialects_is_found():
    rng = random.Random(2)
    main, other = invented(rng, "aeioubcdfg"), invented(rng, "ypqrstvwxz")
    dialects = {f"m{k:02d}": [w if rng.random() < 0.7 else w[::-1] for w in main] for k in range(10)}
    model = learned({"main": main, **dialects, "other": other})
    text = " ".join(rng.sample([*rng.choices(main, k=300), *rng.choices(other, k=120)], 420))
    weights = np.bincount(language.grams(text), minlength=language.BUCKETS)
    alone = weights @ np.log(model.table)
    assert sorted(model.names, key=lambda n: -alone[model.names.index(n)]).index("other") > 8
    name, _, found, _ = model.judge(text)
    assert name == "main" and 0.2 < dict(found)["other"] < 0.4 and len(found) <= 3


def test_language_sets_match_a_search_of_all_subsets():
    rng = random.Random(7)
    words = {f"l{k}": invented(rng, letters) for k, letters in enumerate(["abcdefgh", "efghijkl", "ijklmnop", "mnopqrst", "qrstuvab"])}
    model = learned(words)
    for trial in range(25):
        of = rng.sample(list(words), rng.randrange(1, 4))
        text = " ".join(w for n in of for w in rng.choices(words[n], k=rng.randrange(40, 200)))
        weights = np.bincount(language.grams(text), minlength=language.BUCKETS)
        at = np.flatnonzero(weights)
        w, likely = weights[at].astype(float), model.table[at].astype(float)
        cost = language.PENALTY * np.log(w.sum())
        best = max((model.fit(w, likely[:, list(c)])[1] - cost * len(c), c) for n in range(1, 6) for c in itertools.combinations(range(5), n))
        assert {n for n, _ in model.judge(text)[2]} == {model.names[i] for i in best[1]}, trial


def test_equal_languages_go_by_name_and_any_number_is_learned(spark):
    words = invented(random.Random(1), "abcdefgh")
    assert learned({"b": words, "a2": words}).judge(" ".join(words[:50]))[0] == "b"  # the first given; learn() sorts them
    texts = [" ".join(invented(random.Random(k), "abcdefghijklmnop", 8)) for k in range(1_001)]
    rows = spark.createDataFrame([(k, t, f"x{k:04d}") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.learn(rows)
    assert len(model.names) == 1_001 and model.judge(texts[7])[0] == "x0007"
    clash = rows.limit(3).withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit("mine"))
    assert sorted(r["doc_id"] for r in language.identify(clash, model).collect()) == sorted(r["doc_id"] for r in clash.collect())
    assert language.keep_identified(clash.where("false"), model).count() == 0


def test_filter_drops_texts_of_no_learned_language(spark, docs):
    model = language.learn(docs)
    rng = random.Random(0)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. " * 2
    texts = [None, "", "12 !?", letters, polish, "这是一个用来测试语言识别的中文句子，我们希望它不会被当作英语。" * 3, docs.where("lang = 'fr' AND length(text) > 500").first()["text"], "A."]
    rows = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], docs.schema)
    kept = {r["doc_id"]: r["lang"] for r in language.keep_identified(rows, model).collect()}
    assert set(kept) == {6, 7} and kept[6] == "fr"


def test_filter_keeps_clear_documents(docs):
    model = language.learn(docs)
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.where("text rlike '\\\\p{L}'").count()


def test_quality_is_right_on_held_out_labels(spark):
    rows = queries.op10_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [(r["score"], r["predicted"], r["quality"]) for r in rows if r["held_out"]]
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    assert np.mean([[a > b for a in good] for b in bad]) > 0.97 and np.mean([p == q for _, p, q in held]) > 0.95


def test_trees_fit_steps_and_flat_traversal_is_exact():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.grow(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95

    def walk(row):
        raw = model.base
        for f, c, v in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            raw += v[node - len(f)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose([walk(r) for r in x[:50]], model.score(x[:50]))
    assert quality.grow(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert len(quality.grow(x, np.ones(600)).feature) == 0


def plain_grow(x, y, trees):
    """Boosted trees by loops over nodes, features and cuts; raw scores of the rows."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(x.shape[1])]
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        parts = [np.arange(len(y))]
        for _ in range(quality.DEPTH):
            halves = []
            for rows in parts:
                g, h, best = grad[rows].sum(), hess[rows].sum(), (1e-6, None, None)
                for f in range(x.shape[1]):
                    for cut in edges[f]:
                        left = x[rows, f] <= cut
                        gl, hl = grad[rows][left].sum(), hess[rows][left].sum()
                        if min(hl, h - hl) >= quality.LEAST / 4:
                            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                            if gain > best[0] + 1e-9:
                                best = (gain, f, cut)
                left = x[rows, best[1]] <= best[2] if best[1] is not None else np.ones(len(rows), bool)
                halves += [rows[left], rows[~left]]
            parts = halves
        for rows in parts:
            raw[rows] -= quality.RATE * grad[rows].sum() / (hess[rows].sum() + 1)
    return 1 / (1 + np.exp(-raw))


def test_trees_match_a_plain_learner(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.5 * x[:, 2] + rng.normal(scale=0.5, size=300) > 0.2).astype(float)
    assert np.allclose(quality.grow(x, y).score(x), plain_grow(x, y, 4))


def test_statistics_of_odd_texts(spark):
    for t in (None, "", " ", "a", "ü" * 100_000, "\n\n", "1 2 3"):
        assert len(quality.statistics(t)) == len(quality.FEATURES) and np.isfinite(quality.statistics(t)).all()
    rows = spark.createDataFrame([(1, None, "x"), (1, "a b", "x")], "doc_id long, text string, score string")
    model = quality.learn(rows.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(rows, model).collect()] == [0.5, 0.5] and quality.score(rows.where("false"), model).count() == 0


def plain_mulaw(b):
    b = ~b & 0xFF
    size = (((b & 15) << 3) + 0x84 << (b >> 4 & 7)) - 0x84
    return -size if b & 0x80 else size


def plain_alaw(b):
    b ^= 0x55
    part, size = b >> 4 & 7, ((b & 15) << 4) + 8
    size = size if part == 0 else (size + 256) << (part - 1)
    return size if b & 0x80 else -size


def plain_ima(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.IMA_STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            index = max(0, min(88, index + int(media.IMA_MOVES[code & 7])))
            out.append(sample)
    return out


def test_decoders_match_plain_versions():
    assert media.MULAW_SAMPLES.tolist() == [plain_mulaw(b) for b in range(256)]
    assert media.ALAW_SAMPLES[[0xD5, 0x55, 0x80, 0x2A]].tolist() == [8, -8, 5504, -32256]
    assert len(set(media.ALAW_SAMPLES.tolist())) == 256
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (9, 36), dtype=np.uint8)
    assert media.decode_ima(blocks).tolist() == [plain_ima(b.tobytes()) for b in blocks]


def test_resampling_keeps_a_tone():
    t = np.arange(800)
    tone = (8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    up = media.resample(tone, 8000, 16000)
    wanted = 8000 * np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)
    assert len(up) == 1600 and np.abs(up[100:-100] - wanted[100:-100]).max() < 120
    down = media.resample(up, 16000, 8000)
    assert len(down) == 800 and np.abs(down[50:-50].astype(int) - tone[50:-50]).max() < 300
    assert len(media.resample(tone, 11025, 16000)) == -(-800 * 640 // 441) and len(media.resample(tone[:0], 8000, 16000)) == 0


def test_texts_come_back_from_their_files(spark):
    texts = [None, "", "a", "ä" * 300, "x" * 576, "y" * 577, "long " * 40_000, "a"]
    rows = {r["doc_id"]: r for r in media.texts_as_audio(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.write_wav(payload, media.MULAW, 8000, 8)
        assert stored[-len(payload) :] == payload and (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        if len(payload) < 2000:
            samples, alaw = [plain_mulaw(b) for b in payload], [plain_alaw(b) for b in payload]
            adpcm = [x for k in range(0, len(payload), 576) for x in plain_ima(payload[k : k + 576])]
            mean = lambda v: sum(map(abs, v)) // len(v)
            changes = sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))
            pcm = zlib.crc32(media.resample(np.array(samples, np.int16), 8000, 16000).astype("<i2").tobytes())
            assert r["feature"] == f"level={mean(samples)};peak={max(map(abs, samples))};changes={changes};alaw={mean(alaw)};adpcm={mean(adpcm)};pcm16k={pcm:08x}"
    assert rows[2]["feature"] == rows[7]["feature"] and rows[2]["media_sha256"] == rows[7]["media_sha256"]
    clash = spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, text string, content string, feature string")
    assert media.texts_as_audio(clash).first()["n_bytes"] == 1 and media.texts_as_audio(clash.where("false")).count() == 0


def test_texts_as_resampled_pcm(spark):
    texts = ["", "abc " * 300, "\x7f"]
    stored = media.audio_of_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for r in media.store_pcm(stored, "doc_id").collect():
        payload = media.payload_of(texts[r["doc_id"]])[1]
        _, rate, samples = media.decode_wav(r["pcm"])
        assert rate == 16000 and r["n_samples"] == len(samples) == 2 * len(payload)
        assert samples[::2].tolist() == [plain_mulaw(b) for b in payload]  # doubling the rate keeps the samples themselves


def test_media_rows_of_all_kinds(spark):
    tone = np.arange(-500, 500, dtype="<i2")
    files = [media.write_wav(tone.tobytes(), media.PCM, 8000, 16, 2), media.write_wav(bytes(range(256)), media.MULAW, 8000, 8), media.write_wav(bytes(range(256)), media.ALAW, 8000, 8),
             media.write_wav(bytes(72), media.IMA, 8000, 4, 36), None, b"", b"RIFF1234WAVEjunk", media.write_wav(b"", media.MULAW, 8000, 8)]
    rows = {r["media_id"]: r for r in media.store_pcm(spark.createDataFrame(list(enumerate(files)), "media_id long, content binary")).collect()}
    assert [rows[i]["status"] for i in range(8)] == ["ok", "ok", "ok", "ok", "null", "unsupported", "unsupported", "ok"]
    assert [rows[i]["codec"] for i in range(4)] == ["pcm", "mulaw", "alaw", "ima_adpcm"] and [rows[i]["n_samples"] for i in (0, 1, 3, 7)] == [2000, 512, 260, 0]
    assert media.decode_wav(rows[1]["pcm"])[1] == 16000


URLS = [None, "", "no-scheme.com/x", "https://www.Example.COM/en/1?q#f", "http://a.example.com/en/", "http://example.com/fr/x", "http://example.com", "x://net/es/", "ftp://b.c.net/fr/1", "http://notexample.net/en/",
        "://com/", "http://myexample.com/en/x", "http://org/://com/", "http://user@example.com/en/"]


def plain_judge(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_rules_match_a_plain_version(spark):
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for found in (urls.judge_urls(rows, queries.URL_RULES), urls.judge_urls(rows, queries.URL_RULES, max_index_bytes=10)):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
        assert got == {i: plain_judge(u) for i, u in enumerate(URLS)}
    assert urls.judge_urls(rows.where("false"), queries.URL_RULES).count() == 0


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda key: len(key) % 3)
    rules = [("block", f"h{i}.com", f"/{i}") for i in range(40)]
    index = urls.DigestIndex(urls.build_index(rules))
    assert index.judge([f"h{i}.com" for i in range(40)], [f"/{i}x" for i in range(40)]) == [(f"h{i}.com/{i}", 1) for i in range(40)]
    assert index.judge(["h1.com", "hx.com", ""], ["/2", "/1", "/1"]) == [None, None, None]
    assert urls.DigestIndex(urls.build_index([])).judge(["a.com"], ["/"]) == [None]
    with pytest.raises(ValueError):
        urls.build_index([("maybe", "a.com", "/")])


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.TOKENIZER)
    own = bpe.WordBpe(open(queries.TOKENIZER, encoding="utf-8").read())
    rng = random.Random(3)
    parts = ["a", "B", "'s", "'LL", " ", "\n", "é", "e\u0301", "ß", "Σ", "İ", "1", "²", "中", "\u00a0", "\u0085", "\x1c", "!", "<|endoftext|>", "<|", "😀", "ﬁ", "ab" * 30, "\x00", "हिन्दी"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(800)] + ["", "a" * 4000] + [r["text"] for r in docs.limit(150).collect()]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False), repr(t)


def test_bpe_equals_the_library_for_every_character():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.TOKENIZER)
    own = bpe.WordBpe(open(queries.TOKENIZER, encoding="utf-8").read())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for shape in ("a{}a!{}!1", "á{}̣́"):
        texts = [shape.format(c, c) for c in every]
        for at in range(0, len(texts), 50_000):
            some = texts[at : at + 50_000]
            for text, found in zip(some, library.encode_batch(some, add_special_tokens=False)):
                assert own.encode(text) == found.ids, ascii(text)


def test_marks_stand_in_the_order_of_the_library():
    import unicodedata

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.TOKENIZER)
    own = bpe.WordBpe(open(queries.TOKENIZER, encoding="utf-8").read())
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    probes = list({unicodedata.combining(m): m for m in marks}.values())  # one of each combining class
    texts = ["a" + p for m in marks for p in ["".join(x) for q in probes for x in ((m, q), (q, m))]]
    rng = random.Random(11)
    parts = [*marks, *"aeoçø ", "\u1100", "\u1161", "\u11a8", "\u0928", "\u3099"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 12))) for _ in range(30_000)]
    for at in range(0, len(texts), 20_000):
        some = texts[at : at + 20_000]
        for text, found in zip(some, library.encode_batch(some, add_special_tokens=False)):
            assert own.encode(text) == found.ids, ascii(text)


def test_unknown_steps_are_refused():
    spec = json.loads(open(queries.TOKENIZER, encoding="utf-8").read())
    for part, value in (("normalizer", {"type": "NFKC"}), ("decoder", {"type": "ByteLevel"}), ("model", {**spec["model"], "byte_fallback": True}),
                        ("pre_tokenizer", {"type": "Sequence", "pretokenizers": [{**spec["pre_tokenizer"]["pretokenizers"][0], "behavior": "Isolated"}, spec["pre_tokenizer"]["pretokenizers"][1]]})):
        with pytest.raises(ValueError):
            bpe.WordBpe(json.dumps({**spec, part: value}))
    upper = bpe.WordBpe(json.dumps({**spec, "normalizer": None}))
    assert upper.encode("A b") != upper.encode("a b") and upper.encode("a  b") == upper.encode("a b")


def test_bpe_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, "the cat"), (2, "the cat"), (3, "")], "doc_id long, text string")
    coded = bpe.encode(rows, queries.TOKENIZER)
    back = sorted((r["doc_id"], r["decoded"]) for r in bpe.decode(coded, queries.TOKENIZER).collect())
    assert back == [(1, ""), (2, "the</w> cat</w>"), (2, "the</w> cat</w>"), (3, "")]
    got = bpe.round_trip(rows, queries.TOKENIZER).collect()
    clash = rows.withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit("mine"))
    assert bpe.round_trip(clash, queries.TOKENIZER).count() == 4 and bpe.encode_beside(rows.where("false"), queries.TOKENIZER).count() == 0
    assert {r["n_tokens"] for r in got} == {0, 2} and bpe.round_trip(rows.where("false"), queries.TOKENIZER).count() == 0
    assert json.loads(open(queries.TOKENIZER).read())["model"]["type"] == "BPE"
