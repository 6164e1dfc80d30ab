"""Packing along the curve: every id in one piece, gapless sequences, no padding, order and ids as stated."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleanery.llm import packing, queries
from gleanery.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(TOKENIZER)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, docs, length=4096):
    """pieces as rows with ids_crc32 against (doc_id, text) rows; doc_ids are unique."""
    by, held = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        held[p["sequence_id"]].append(p)
    assert set(by) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = ids_of(text), 0
        for p in sorted(by[i], key=lambda p: p["start"]):
            part = ids[at : at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p["length"]
        assert at == len(ids)
    for own in held.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == length or (at < length and at & (at - 1) == 0)
    total = sum(p["length"] for p in pieces)
    assert sorted(held) == list(range(total // length + (total % length).bit_count()))


def test_all_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op13_packing(spark, SF).collect(), docs)


def test_many_parts_give_the_same_stream(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(map(tuple, packing.packing_digests(docs, TOKENIZER).collect()))
    monkeypatch.setattr(packing, "PART_TOKENS", 3_000)
    assert sorted(map(tuple, packing.packing_digests(docs, TOKENIZER).collect())) == whole


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_TOKENS", 500)
    rng = random.Random(3)
    letters = "ab Ḉ̸ Σς İ  x​ȩ́́ <|endoftext|> <|startoftext|>'s'll 12½ 日本 ẛ̣ \U0001f600 \x1c\x85"
    odd = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(60)]
    texts = [None, "", "   ", "\n\t", "x" * 5_000, "word " * 30_000, "a<|endoftext|>b", " é é ", *odd, *["copy of one text"] * 50]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS place", "3 AS ids", "4 AS begin", "5 AS part")
    check(packing.packing_digests(frame, TOKENIZER).collect(), list(enumerate(texts)))


def test_null_keys_repeats_and_no_rows(spark):
    frame = spark.createDataFrame([(None, "a b c"), (None, None), (7, "a b c"), (7, "a b c"), (7, "d")], "doc_id long, text string")
    rows = packing.packing_digests(frame, TOKENIZER).collect()
    want = sum(len(ids_of(t)) for t in ["a b c", None, "a b c", "a b c", "d"])
    assert sum(r["length"] for r in rows) == want and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.packing_digests(frame.where("false"), TOKENIZER).collect() == []
    named = frame.where("doc_id = 7").selectExpr("CAST(doc_id AS STRING) AS name", "text")
    assert sum(r["length"] for r in packing.pack(named, TOKENIZER, key="name").collect()) == 10


def test_sequences_hold_the_ids_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    texts = {r["doc_id"]: ids_of(r["text"]) for r in docs.collect()}
    for r in packing.sequences(packing.pack(docs, TOKENIZER, length=512)).collect():
        want = [x for s in r["spans"] for x in texts[s["doc_id"]][s["start"] : s["start"] + s["length"]]]
        assert np.frombuffer(r["ids"], "<u2").tolist() == want and len(want) == r["length"]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = packing.hilbert(cells, bits)
    assert sorted(at.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_copies_lie_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) BETWEEN 500 AND 3000")
    copies = docs.groupBy("text").agg({"doc_id": "collect_list"}).where("size(`collect_list(doc_id)`) > 1").collect()
    at = {r["doc_id"]: r["sequence_id"] for r in packing.pack(docs, TOKENIZER).where("start = 0").collect()}
    far = [max(at[i] for i in c[1]) - min(at[i] for i in c[1]) for c in copies]
    assert copies and np.mean(far) <= 1
