"""Packing documents into sequences of a fixed length, along a space-filling curve.

A document's tokens are its ids by the tokenizers library and an end id. Its vector counts the tokens by hashed bucket
with a sign, damped and scaled to length one; a fixed random projection takes that to DIMS coordinates, and a Hilbert
curve through their grid gives the document's place. Documents stand in order of their places, so neighbours on the
curve, and copies above all, share sequences. Their tokens form one stream, cut every `length` tokens. What is left at
the end is cut into powers of two, so no sequence needs padding.

The stream is never in one place. Documents are dealt by range of their place into parts of about PART_TOKENS tokens;
the borders come from a sample, as in Spark's own range sort, and change no row. Sums of the parts, at most MAX_PARTS
numbers, say where each part's stream begins; inside a part a running sum does. Places end in a hash of the key and of
the row, so that a group of copies of any size spreads over many parts.

Words are split at ASCII white space, which no token spans, and each distinct word of a batch is encoded once.

A null text is taken as empty; a text without tokens has the end id alone. Null keys and repeated rows are packed like
any others, each row by itself; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.llm import bpe
from gleanery.llm.columns import slices
from gleanery.llm.mixing import literal
from gleanery.session import materialise

LENGTH, END_ID = 4_096, 2
#: Buckets of the hashed vector; coordinates of its projection and bits of each.
BUCKETS, DIMS, DIM_BITS = 256, 4, 10
#: Bits of a place that follow those of the curve: from the key, from the row.
KEY_BITS, ROW_BITS = 12, 11
PART_TOKENS, MAX_PARTS, SAMPLED = 1 << 20, 100_000, 20
#: Words remembered by each Python worker, and the longest of them.
CACHE_WORDS, CACHE_LENGTH = 1_000_000, 64
_RANDOM = np.random.Generator(np.random.PCG64(13))
PROJECTION = np.linalg.qr(_RANDOM.standard_normal((BUCKETS, DIMS)))[0]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places along a Hilbert curve of the rows of cells, each a point of a grid with 2**bits cells a side."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns of the larger cubes
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            inside = (x[i] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] ^ turn) >> b & 1
    return place


class Words:
    """Ids of words by the tokenizers library, as bytes of one unit an id."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        top = 1 + max(self.library.get_vocab(with_added_tokens=True).values())
        self.unit = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        hashes = np.random.Generator(np.random.PCG64(7)).integers(0, 2 * BUCKETS, top)
        self.bucket, self.sign = hashes >> 1, (hashes & 1) * 2.0 - 1
        self.known: dict[str, bytes] = {}
        data = json.loads(spec)
        steps = [x["type"] for x in (data["normalizer"] or {}).get("normalizers", [])]
        cuts = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (data["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and cuts == [("Split", bpe.FILE_PATTERN), ("ByteLevel", None)]
        self.letters = str.maketrans({chr(c): "".join(bpe.byte_alphabet()[x] for x in chr(c).encode()) for c in range(256)})

    def plain_texts(self, texts: pa.Array) -> pa.Array:
        """Which texts may be lower-cased before they are split: plain ones without the marks of special tokens."""
        return pc.invert(pc.match_substring_regex(texts, r"[^\t-\r\x20-\x7EÀ-ÖØ-öø-ÿ]|<\|"))

    def ids(self, word: str) -> list[int]:
        """The library's ids of a word; a plain one is cut here, which spares the library's slow normaliser."""
        if self.plain and "<|" not in word and bpe.PLAIN.fullmatch(word):
            return [t.id for piece in bpe.PLAIN_PIECE.findall(word.lower()) for t in self.library.model.tokenize(piece.translate(self.letters))]
        return self.library.encode(word, add_special_tokens=False).ids

    def of(self, words: list[str]) -> list[bytes]:
        found = [self.known.get(w) for w in words]
        for i, x in enumerate(found):
            if x is None:
                found[i] = x = np.array(self.ids(words[i]), self.unit).tobytes()
                if len(self.known) < CACHE_WORDS and len(words[i]) <= CACHE_LENGTH:
                    self.known[words[i]] = x
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, an end id after each, and how many each has."""
        texts = pc.fill_null(texts, "")
        if self.plain:
            # A mark after a word is a token of its own: apart, both are met more often.
            apart = pc.replace_substring_regex(pc.utf8_lower(texts), r"([a-zß-öø-ÿ])([.,;:!?]+)(\s|$)", r"\1 \2\3")
            texts = pc.if_else(self.plain_texts(texts), apart, texts)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        parts = [*self.of(coded.dictionary.to_pylist()), np.array([end_id], self.unit).tobytes()]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.unit.itemsize
        table, starts = np.frombuffer(b"".join(parts), self.unit), np.cumsum(sizes) - sizes
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        words = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(parts) - 1)
        long = sizes[words]
        after = np.cumsum(long)
        ids = table[np.repeat(starts[words] - (after - long), long) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.diff(after[ends + np.arange(len(ends))], prepend=0)

    def cells(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The grid cells of documents by their hashed vectors; the end id of each doesn't count."""
        n = len(counts)
        owner = np.repeat(np.arange(n), counts)
        weight = self.sign[ids]
        weight[np.cumsum(counts) - 1] = 0
        sums = np.bincount(owner * BUCKETS + self.bucket[ids], weight, n * BUCKETS).reshape(n, BUCKETS)
        vectors = np.sign(sums) * np.log1p(np.abs(sums))
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        share = 0.5 + np.arctan(8 * (vectors @ PROJECTION)) / np.pi
        return np.minimum((share * (1 << DIM_BITS)).astype(np.int64), (1 << DIM_BITS) - 1)


@lru_cache(maxsize=2)
def words_of(spec: str) -> Words:
    return Words(spec)


def placed(docs: DataFrame, path: str, key: str, text: str, end_id: int) -> DataFrame:
    """key, place, row (a number of its own), tokens (their number) and ids (as bytes of one unit an id) of every row."""
    spec = bpe.load(docs.sparkSession, path)
    source = docs.select(docs[key].alias("key"), F.xxhash64(docs[key]).alias("hash"), docs[text].alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(spec.value)
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches, 2):
            ids, counts = words.encode(part.column(2), end_id)
            rows = np.arange(row, row + len(counts))
            row += len(counts)
            tail = (part.column(1).to_numpy() & (1 << KEY_BITS) - 1) << ROW_BITS | (rows * 0x9E3779B1 >> 16) & (1 << ROW_BITS) - 1
            place = hilbert(words.cells(ids, counts), DIM_BITS) << KEY_BITS + ROW_BITS | tail
            ends = np.cumsum(counts) * words.unit.itemsize
            cut = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(np.insert(ends, 0, 0).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(place), pa.array(rows), pa.array(counts), cut], ["key", "place", "row", "tokens", "ids"])

    return source.mapInArrow(run, f"key {kind}, place long, row long, tokens long, ids binary")


def part_of(place: Column, borders: list[int]) -> Column:
    """How many of the sorted borders are at most place, by halving."""
    if not borders:
        return F.lit(0)
    known = literal(borders, "bigint")

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.get(known, (at + step - 1).cast("int")) <= place, at + step).otherwise(at)

    steps = [1 << b for b in range(len(borders).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), halve)


def streams(docs: DataFrame, path: str, key: str, text: str, end_id: int) -> tuple[DataFrame, int]:
    """key, tokens, ids and begin (the place in the stream of the first) of every row; the length of the stream."""
    rows = materialise(placed(docs, path, key, text, end_id), "pack-tokens", compression="zstd")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    parts = min(MAX_PARTS, 1 + total // PART_TOKENS)
    share = min(1.0, SAMPLED * parts / max(n, 1))
    # About SAMPLED * MAX_PARTS numbers at most; where the borders lie changes the load of tasks and no row.
    sample = sorted(r[0] for r in rows.select("place").sample(share, 13).collect()) if parts > 1 else []
    borders = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    rows = rows.withColumn("part", part_of(F.col("place"), borders))
    sums = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    bases = [0]
    for i in range(len(borders)):
        bases.append(bases[-1] + sums.get(i, 0))
    before = Window.partitionBy("part").orderBy("place", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.get(literal(bases, "bigint"), F.col("part")) + F.coalesce(F.sum("tokens").over(before), F.lit(0))
    return rows.select("key", "tokens", "ids", begin.alias("begin")), total


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """key, start, length, doc_tokens, sequence_id, offset and ids (bytes, one unit of two or four an id) of every piece.

    A piece is a run of a document's tokens that lies in one sequence: start counts the document's tokens before it,
    offset the sequence's.
    """
    pieces, total = streams(docs, path, key, text, end_id)
    full = total // length
    tails, at = [], full * length  # where the sequences of the rest begin
    for b in range(length.bit_length() - 1, -1, -1):
        if total % length >> b & 1:
            tails.append(at)
            at += 1 << b
    begin, end = F.col("begin"), F.col("begin") + F.col("tokens")
    last = F.least(end - 1, F.lit(full * length))
    cuts = F.sequence(F.floor(begin / length) + 1, F.greatest(F.floor(last / length), F.floor(begin / length) + 1))
    cuts = F.filter(F.transform(cuts, lambda s: s * length), lambda p: (p > begin) & (p < end) & (p <= full * length))
    more = F.filter(literal(tails[1:], "bigint"), lambda p: (p > begin) & (p < end))
    from_ = F.concat(F.array(begin), cuts, more)
    to = F.concat(cuts, more, F.array(end))
    pieces = pieces.select("key", "tokens", "begin", "ids", F.explode(F.arrays_zip(from_.alias("a"), to.alias("b"))).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    tail = F.filter(literal(tails, "bigint"), lambda t: t <= a)
    in_tail = a >= F.lit(full * length)
    sequence = F.when(in_tail, F.lit(full) + F.size(tail) - 1).otherwise(F.floor(a / length)).cast("long")
    offset = F.when(in_tail, a - F.get(tail, F.size(tail) - 1)).otherwise(a % length).cast("long")
    unit = F.expr("bit_length(ids) div 8 div tokens")
    bytes_ = F.substring("ids", ((a - F.col("begin")) * unit + 1).cast("int"), ((b - a) * unit).cast("int"))
    return pieces.select(
        F.col("key").alias(key), (a - F.col("begin")).alias("start"), (b - a).alias("length"), F.col("tokens").alias("doc_tokens"),
        sequence.alias("sequence_id"), offset.alias("offset"), bytes_.alias("ids"))


def sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """sequence_id, length, ids (bytes) and spans (key, start, length of each piece, in order) of the sequences of pack()."""
    span = F.struct("offset", "ids", F.struct(key, "start", "length").alias("span"))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(span)).alias("parts"))  # LENGTH pieces at most
    joined = F.aggregate(F.transform("parts", lambda p: p["ids"]), F.lit(b""), lambda x, y: F.concat(x, y))
    return rows.select("sequence_id", "length", joined.alias("ids"), F.transform("parts", lambda p: p["span"]).alias("spans"))


def packing_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces with ids_crc32 in place of their ids: the check sum of the ids as little-endian numbers of four bytes."""
    words = bpe.load(docs.sparkSession, path)

    @F.pandas_udf("long")
    def check(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        unit = words_of(words.value).unit
        for part in parts:
            yield pd.Series([zlib.crc32(np.frombuffer(x, unit).astype("<u4")) for x in part], dtype="int64")

    return pack(docs, path, key, text).withColumn("ids_crc32", check("ids")).drop("ids")
