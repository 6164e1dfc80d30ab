"""BPE encoding and decoding with a public tokenizer's vocabulary file.

A text is cut at special tokens, normalised by the steps that the file names and cut into pieces by its pattern; each
piece starts as one symbol a byte in a doubly linked list, the last one with the word-end mark. A priority queue
holds (rank, position) of every mergeable neighbour pair; entries whose symbols have changed since are stale and
skipped. Decoding joins vocabulary strings, as the file names no decoder: one blank between tokens.

Letters, digits, lower case and the order of marks are those of the tokenizers library, which knows Unicode 16 for the
first three and an older one for the last, whatever versions Python and its packages have. A file whose steps aren't
known here is refused.

Null is taken as the empty text, which gives no tokens. Long texts are encoded whole. Equal texts give equal ids.
Repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gleanery.llm.columns import slices

#: Pieces remembered by each Python worker.
CACHE_PIECES = 100_000
#: Texts of these characters alone need no normaliser but lower(), and this pattern cuts them as the file's does.
PLAIN = re.compile(r"[\t-\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_PIECE = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-zß-öø-ÿ0-9]+")

# Letters and digits that came with Unicode 16, beside those of the Unicode 15.1 that Python 3.13 knows.
ADDED = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 "
         "11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}
# Capitals of Unicode 16 and 17 with their small letters; a range goes up by one number throughout.
LOWERED = "1C89>1C8A A7CB>264 A7CC>A7CD A7CE>A7CF A7D2>A7D3 A7D4>A7D5 A7DA>A7DB A7DC>19B 10D50-10D65>10D70 16EA0-16EB8>16EBB"
# Marks that the library doesn't reorder and a vowel sign that it doesn't compose, as they came after its table.
UNORDERED = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B "
    "1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE "
    "1E2EC-1E2EF 1E4EC-1E4EF")


def spans_of(listed: str) -> list[tuple[int, int]]:
    """First and last numbers of the ranges in a list."""
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (x.partition("-") for x in listed.split())]


def char_class(spans: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans)


@lru_cache(maxsize=2)
def category(kind: str) -> str:
    """The inside of a character class of all letters (L) or digits (N)."""
    added = spans_of(ADDED[kind])
    known = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind]
    spans = []
    for c in sorted({*known, *(c for a, b in added for c in range(a, b + 1))}):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return char_class(spans)


MARKS = regex.compile(f"[{char_class(spans_of(UNORDERED))}]+")
SMALL = {}
for _row in LOWERED.split():
    _from, _, _to = _row.partition(">")
    for _a, _b in spans_of(_from):
        SMALL |= {c: int(_to, 16) + c - _a for c in range(_a, _b + 1)}


def composed(text: str) -> str:
    """NFC, as if the marks of UNORDERED were letters of their own."""
    if text.isascii() or not MARKS.search(text):
        return unicodedata.normalize("NFC", text)
    parts, at = [], 0
    for m in MARKS.finditer(text):
        parts += [unicodedata.normalize("NFC", text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*parts, unicodedata.normalize("NFC", text[at:])])


def lowered(text: str) -> str:
    """Lower case, each character by itself: no rule for a final sigma."""
    text = text.translate(SMALL) if not text.isascii() else text
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def pattern_of(spec: dict) -> regex.Pattern:
    """A pattern of the file, with letters and digits as the library knows them."""
    if "Regex" not in spec:
        return regex.compile(regex.escape(spec["String"]))
    source = spec["Regex"]
    for kind in "LN":
        if f"\\p{{{kind}}}" in source:
            source = source.replace(f"\\p{{{kind}}}", category(kind))
    if regex.search(r"\\[pP]\{", source) or regex.search(r"(?<!\[|\^|\\s)\\p\{[LN]\}", spec["Regex"].replace(r"\p{L}\p{N}", r"\p{L}")):
        raise ValueError(f"this pattern isn't supported: {spec['Regex']}")
    return regex.compile(source)


def normaliser(spec: dict | None) -> list:
    """The steps of a file's normaliser as functions of a text."""
    if spec is None:
        return []
    if spec["type"] == "Sequence":
        return [f for one in spec["normalizers"] for f in normaliser(one)]
    if spec["type"] == "NFC":
        return [composed]
    if spec["type"] == "Lowercase":
        return [lowered]
    if spec["type"] == "Replace":
        pattern, content = pattern_of(spec["pattern"]), spec["content"]
        return [lambda text: pattern.sub(lambda _: content, text)]
    raise ValueError(f"this normaliser isn't supported: {spec['type']}")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Remembered(dict):
    """Pieces with their ids as text, their decoded form and their ids, made when first asked for; the first CACHE_PIECES stay."""

    def __init__(self, bpe: WordBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[str, str, list[int]]:
        ids = self.bpe.merge(piece.encode())
        made = (" ".join(map(str, ids)), " ".join([self.bpe.strings[i] for i in ids]), ids)
        if len(self) < CACHE_PIECES and len(piece) <= 64:
            self[piece] = made
        return made


class WordBpe:
    """The tokenizer of one vocabulary file, for pieces with a word-end mark."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        self.ranks: dict[int, int] = {}  # by left id * 2**32 + right id
        self.made: list[int] = []  # by rank
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.last = [self.vocab.get(c + self.end) for c in alphabet]
        first, second = data["pre_tokenizer"]["pretokenizers"]
        if (first["type"], first["behavior"], first["invert"], second["type"], second["add_prefix_space"], second["use_regex"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError("these steps before the merges aren't supported")
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) or data["decoder"]:
            raise ValueError("this kind of model isn't supported")
        self.steps = normaliser(data["normalizer"])
        self.piece = pattern_of(first["pattern"])
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.known = Remembered(self)
        steps = [x["type"] for x in (data["normalizer"] or {}).get("normalizers", [])]
        self.plain = first["pattern"].get("Regex") == FILE_PATTERN and steps == ["NFC", "Replace", "Lowercase"]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        n, rank_of, queue = len(ids), self.ranks.get, []
        for i in range(n - 1):
            if (rank := rank_of(ids[i] << 32 | ids[i + 1])) is not None:
                queue.append(rank << 32 | i)
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            left, j = ids[i], after[i]
            if left < 0 or j >= n or rank_of(left << 32 | ids[j]) != rank:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = new, _ = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(new << 32 | ids[k])) is not None:
                    heappush(queue, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of(ids[h] << 32 | new)) is not None:
                heappush(queue, rank << 32 | h)
        return [i for i in ids if i >= 0]

    def normal(self, text: str) -> str:
        for step in self.steps:
            text = step(text)
        return text

    def cut(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if self.plain and PLAIN.fullmatch(text):
            return PLAIN_PIECE.findall(text.lower())
        return self.piece.findall(self.normal(text))

    def pieces(self, text: str) -> list[tuple[str, str, list[int]]]:
        """What is remembered of each piece and special token of a text."""
        found, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            found += map(self.known.__getitem__, self.cut(text[at : m.start()]))
            found.append((str(self.specials[m[0]]), m[0], [self.specials[m[0]]]))
            at = m.end()
        found += map(self.known.__getitem__, self.cut(text[at:]))
        return found

    def coded(self, text: str | None) -> tuple[str, str]:
        """The ids of a text, joined by blanks, and its decoded form."""
        found = self.pieces(text or "")
        ids, forms = [x[0] for x in found], [x[1] for x in found]
        if "" in ids:  # pieces without a token, where a vocabulary lacks some byte
            ids, forms = [i for i in ids if i], [f for f in forms if f]
        return " ".join(ids), " ".join(forms)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable([x[2] for x in self.pieces(text or "")]))

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@lru_cache(maxsize=2)
def tokenizer(spec: str) -> WordBpe:
    return WordBpe(spec)


def load(spark, path: str):
    """The vocabulary file's text as a broadcast: 2 MB for 49,408 tokens, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) of every row."""
    spec = load(docs.sparkSession, path)
    source = docs.select(docs[key], docs[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for part in slices(batches, 1):
            ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, ids array<int>")


def encode_beside(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with the text replaced by its ids (array of int) and their number, n_tokens."""
    spec = load(docs.sparkSession, path)
    at = docs.columns.index(text)
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for part in slices(batches, at):
            ids = [bpe.encode(t) for t in part.column(at).to_pylist()]
            columns = [c for i, c in enumerate(part.columns) if i != at]
            counts = pa.array(map(len, ids), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32())), counts], [*others, "ids", "n_tokens"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{kinds}, ids array<int>, n_tokens long")


def decode(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the decoded text of every row; unknown ids are passed over, null gives the empty text."""
    spec = load(coded.sparkSession, path)
    source = coded.select(coded[key], coded[ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            out = pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], [key, "decoded"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, decoded string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of both directions, made in one pass: key, n_tokens, ids_sha256, decoded_sha256."""
    spec = load(docs.sparkSession, path)
    source = docs.select(docs[key], docs[text])
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]

    def digests(bpe: WordBpe, value: str | None) -> tuple[int, str, str]:
        ids, decoded = bpe.coded(value)
        count = ids.count(" ") + 1 if ids else 0
        return count, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for part in slices(batches, 1):
            rows = [digests(bpe, t) for t in part.column(1).to_pylist()]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
