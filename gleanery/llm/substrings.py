"""Exact removal of repeated passages, behind a count-min prefilter.

A window is WINDOW consecutive words of one document. Its mark is the least hash of the GRAM-word grams inside it, so
neighbouring windows mostly share a mark, and equal windows always do. Runs of windows with one mark are counted: every
partition makes a sketch of its runs' marks, the sketches merge, and a mark whose estimate is below two can't belong to
a repeated window (an estimate is never too small). The second pass takes the windows whose mark is estimated repeated,
together with those that repeat inside one run. Each partition settles which of its windows repeat an earlier one of its
own; the first occurrences go on, dealt by mark, and are grouped exactly. So a passage that a third of all documents
hold sends no more than one window a partition to the task of its mark.

Windows are equal if their 64-bit hashes and marks are equal. "Earlier" is a smaller key, or the same document and a
smaller start; keys are whole numbers, null counts as the greatest long, and two texts of one key stand in order of their hashes. Rows equal in key and text
are one document and get the same answer. Null and wordless texts have no words; texts of fewer words than a window
keep all. The sketch has CELLS_EACH cells for each expected run, up to MAX_CELLS; beyond that its estimates grow coarser and
the second pass larger, the result stays the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gleanery.llm.columns import slices

WINDOW, GRAM = 20, 8
#: The sketch: rows of cells, cells for each expected run, most cells in a row, and the blocks in which they merge.
DEPTH, CELLS_EACH, MAX_CELLS, BLOCKS = 2, 4, 1 << 28, 64
#: Characters of text for which one run is expected.
CHARS_A_RUN = 40
LAST = (1 << 63) - 1
#: Windows that a task holds, at 28 bytes each, before it hands on what it has.
MOST_HELD = 4_000_000
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)
BLANKS = b" \t\n\v\f\r"
WORD_BYTES = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= B
    x ^= x >> np.uint64(29)
    return x


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * A + (right ^ C))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in the bytes."""
    padded = b" " + raw + b" " * 9
    space = SPACE[np.frombuffer(padded, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2] + 1, edge[1::2] + 1
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    left = ends - starts
    value = left.astype(np.uint64) * C
    active, at = np.arange(len(starts)), starts
    while len(active):
        rest = np.minimum(left[active], 8)
        value[active] = mixed((value[active] ^ (lanes[at] & LOW[rest])) * A)
        left[active] -= 8
        more = left[active] > 0
        active, at = active[more], at[more] + 8
    return value, starts - 1


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span, least = 1, x
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(x) - width + 1], least[width - span :][: len(x) - width + 1])


class Windows:
    """The windows of some texts, laid end to end: owner (text number), start, hash, mark, and the run each belongs to."""

    def __init__(self, texts: list[str | None]) -> None:
        raws = [(t or "").encode() for t in texts]
        hashes, at = word_hashes(b"\n".join(raws))
        borders = np.cumsum([0, *(len(r) + 1 for r in raws)])
        first = np.searchsorted(at, borders)  # first word of each text
        n = len(hashes)
        self.count = np.diff(first)
        empty = np.zeros(0, np.uint64)
        self.hash = self.mark = empty
        self.owner = self.start = self.run = np.zeros(0, np.int64)
        self.twice = np.zeros(0, bool)
        if n < WINDOW:
            return
        two = joined(hashes[:-1], hashes[1:])
        four = joined(two[:-2], two[2:])
        eight = joined(four[:-4], four[4:])
        sixteen = joined(eight[:-8], eight[8:])
        m = n - WINDOW + 1
        whole = joined(sixteen[:m], four[16 : 16 + m])
        mark = sliding_least(eight, WINDOW - GRAM + 1)[:m]
        owner = np.repeat(np.arange(len(raws)), self.count)[:m]
        start = np.arange(m) - first[owner]
        inside = start + WINDOW <= self.count[owner]
        self.hash, self.mark, self.owner, self.start = whole[inside], mark[inside], owner[inside], start[inside]
        if not len(self.hash):
            return
        new = np.ones(len(self.hash), bool)
        new[1:] = (self.mark[1:] != self.mark[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.run = np.cumsum(new) - 1
        self.run_mark = self.mark[new]
        # Runs in which a window repeats: the text has a period shorter than a window there.
        self.twice = np.zeros(len(self.run_mark), bool)
        for lag in range(1, WINDOW):
            same = np.flatnonzero((self.hash[lag:] == self.hash[:-lag]) & (self.run[lag:] == self.run[:-lag]))
            self.twice[self.run[same]] = True
        longest = np.flatnonzero(np.bincount(self.run) > WINDOW)
        self.twice[longest] = True


def cells_of(marks: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((marks * (A, B)[row]) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, bits: int) -> list[np.ndarray]:
    """For each row of the sketch the bitmap of the cells whose merged count is two or more."""
    block = max(1, (1 << bits) // BLOCKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit() -> Iterator[pa.RecordBatch]:
            marks = np.concatenate(held)
            for row in range(DEPTH):
                cells, n = np.unique(cells_of(marks, row, bits), return_counts=True)
                cells = np.repeat(cells, np.minimum(n, 2))
                cuts = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, block))
                parts = [(cells[a:b] % block).astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                blocks = [row * len(parts) + k for k in range(len(parts))]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())], ["block", "cells"])

        size = 0
        for part in slices(batches, 1, 2 << 20):
            found = Windows(part.column(1).to_pylist())
            if len(found.hash):
                held.append(found.run_mark)
                size += len(found.run_mark)
            if size > 4_000_000:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if number not in counts:
                    counts[number] = np.zeros(block, np.uint8)
                at = np.frombuffer(cells, "<u4")
                twice = at[1:][at[1:] == at[:-1]]
                counts[number][at] = np.minimum(counts[number][at] + 1, 2)
                counts[number][twice] = 2
        for number, total in counts.items():
            bitmap = np.packbits(total >= 2).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([bitmap], pa.binary())], ["block", "cells"])

    schema = "block int, cells binary"
    merged = docs.mapInArrow(count, schema).repartition("block").mapInArrow(merge, schema)
    blocks = (1 << bits) // block
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
    for r in merged.collect():  # DEPTH * MAX_CELLS bits at most
        row, k = divmod(r["block"], blocks)
        rows[row][k * block // 8 : (k + 1) * block // 8] = np.frombuffer(r["cells"], np.uint8)
    return rows


def repeated(rows: list[np.ndarray], marks: np.ndarray, bits: int) -> np.ndarray:
    """Whether each mark's estimate is two or more."""
    out = np.ones(len(marks), bool)
    for row, bitmap in enumerate(rows):
        cells = cells_of(marks, row, bits)
        out &= (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def later_ones(hashes: np.ndarray, marks: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether an equal window stands at a smaller place."""
    order = np.lexsort((place, marks, hashes))
    h, m, p = hashes[order], marks[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
    least = p[new][np.cumsum(new) - 1] if len(h) else p
    out = np.zeros(len(h), bool)
    out[order] = p != least
    return out


def ranks(keys: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Place of each (key, text hash) in their order, equal ones alike."""
    order = np.lexsort((texts, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (texts[order][1:] != texts[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def stretches(owner: np.ndarray, start: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of the stretches in which owner (and other) stay and start goes up by one."""
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    if other is not None:
        new[1:] |= other[1:] != other[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(start)))


NAMES = ["mark", "key", "text_hash", "start", "n", "hashes"]


def batch_of(mark, key, text_hash, start, n, hashes) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((mark, key, text_hash, start, n, hashes), kinds, strict=True)], NAMES)


def repeats(docs: DataFrame) -> DataFrame:
    """Stretches of windows of docs (key, text, text_hash) that repeat an earlier one: key, text_hash, start, n windows."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MAX_CELLS.bit_length() - 1, max(10, (CELLS_EACH * chars // CHARS_A_RUN).bit_length()))
    shared = spark.sparkContext.broadcast(sketch(docs, bits))

    def first_ones(held: list[tuple[np.ndarray, ...]], keys: list[np.ndarray], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Of the windows held, those that repeat another of them are settled; of equal ones the first goes on."""
        if not held:
            return
        owner, start, hashes, marks = (np.concatenate(c) for c in zip(*held, strict=True))
        key, text = np.concatenate(keys), np.concatenate(texts)
        later = later_ones(hashes, marks, ranks(key, text)[owner] << 32 | start)
        if later.any():
            o, s = owner[later], start[later]
            at, n = stretches(o, s)
            spread = (key[o[at]] * 31 + text[o[at]]).astype(np.int64)  # settled: dealt by document
            yield batch_of(spread, key[o[at]], text[o[at]], s[at], n, [None] * len(at))
        o, s, h, m = owner[~later], start[~later], hashes[~later], marks[~later]
        at, n = stretches(o, s, m)
        for lo in range(0, len(at), 20_000):
            some, count = at[lo : lo + 20_000], n[lo : lo + 20_000]
            flat = h[some[0] : some[-1] + count[-1]].astype("<u8").tobytes()
            offset = some - some[0]
            parts = [flat[8 * a : 8 * (a + c)] for a, c in zip(offset.tolist(), count.tolist(), strict=True)]
            yield batch_of(m[some].view(np.int64), key[o[some]], text[o[some]], s[some], count, parts)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        keys: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        base = size = 0
        for part in slices(batches, 1, 2 << 20):
            found = Windows(part.column(1).to_pylist())
            keys.append(part.column(0).to_numpy())
            texts.append(part.column(2).to_numpy())
            if len(found.hash):
                runs = repeated(shared.value, found.run_mark, bits) | found.twice
                at = np.flatnonzero(runs[found.run])
                held.append((found.owner[at] + base, found.start[at].astype(np.int32), found.hash[at], found.mark[at]))
                size += len(at)
            base += part.num_rows
            if size > MOST_HELD:
                yield from first_ones(held, keys, texts)
                held, keys, texts, base, size = [], [], [], 0, 0
        yield from first_ones(held, keys, texts)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settled(part: pa.Table) -> pa.RecordBatch | None:
            mark, key, text = (part[c].to_numpy() for c in ("mark", "key", "text_hash"))
            start, n = part["start"].to_numpy().astype(np.int64), part["n"].to_numpy().astype(np.int64)
            known = part["hashes"].is_null().to_numpy()
            rows = np.flatnonzero(~known)
            hashes = np.frombuffer(b"".join(part["hashes"].drop_null().to_pylist()), "<u8")
            row = np.repeat(rows, n[rows])
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
            place = ranks(key, text)[row] << 32 | start[row] + inner
            later = later_ones(hashes, mark[row].view(np.uint64), place)
            r, s = row[later], (start[row] + inner)[later]
            at, count = stretches(r, s)
            some = r[at]
            keys, texts = np.concatenate([key[known], key[some]]), np.concatenate([text[known], text[some]])
            starts, counts = np.concatenate([start[known], s[at]]), np.concatenate([n[known], count])
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(texts, pa.int64()), pa.array(starts, pa.int32()), pa.array(counts, pa.int32())], NAMES[1:5])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.column(0).to_numpy()
            cut = int(np.searchsorted(marks, marks[-1]))  # the last mark may go on in the next batch
            if cut or (held and held[-1].column(0)[-1].as_py() != marks[0]):
                whole = pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
                yield settled(whole)
            held.append(batch.slice(cut))
        if held:
            yield settled(pa.Table.from_batches(held))

    rows = docs.mapInArrow(candidates, "mark long, key long, text_hash long, start int, n int, hashes binary")
    return rows.repartition("mark").sortWithinPartitions("mark").mapInArrow(settle, "key long, text_hash long, start int, n int")


def covered(n_words: int, found: list[dict] | None) -> np.ndarray:
    """Which of a document's words stand in a repeated window."""
    change = np.zeros(n_words + 1, np.int64)
    for r in found or ():
        change[r["start"]] += 1
        change[min(n_words, r["start"] + r["n"] + WINDOW - 1)] -= 1
    return np.cumsum(change[:-1]) > 0


def with_repeats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with _repeats, an array of (start, n) of their repeated windows, or null."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must be a whole number: it orders the documents")
    marked = docs.withColumns({"_key": F.coalesce(docs[key].cast("long"), F.lit(LAST)), "_text_hash": F.xxhash64(docs[text])})
    small = marked.select(F.col("_key").alias("key"), docs[text].alias("text"), F.col("_text_hash").alias("text_hash"))
    found = repeats(small).groupBy("key", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("_repeats"))
    found = found.select(F.col("key").alias("_r_key"), F.col("text_hash").alias("_r_hash"), "_repeats")
    joined_ = marked.join(found, (marked["_key"] == found["_r_key"]) & (marked["_text_hash"] == found["_r_hash"]), "left")
    return joined_.select(*docs.columns, "_repeats")


def removal_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, and the SHA-256 of the kept words joined by one blank."""
    rows = with_repeats(docs.select(docs[key], docs[text]), key, text)
    names = [key, "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            out = []
            for value, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = (value or "").encode().split()
                if found:
                    gone = covered(len(words), found)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, digest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """docs with the words of repeated windows cut out of the text, the white space before kept words left, and size renewed."""
    rows = with_repeats(docs, key, text)
    at, size_at, last = docs.columns.index(text), docs.columns.index(size), len(docs.columns)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            out = []
            for value, found in zip(part.column(at).to_pylist(), part.column(last).to_pylist(), strict=True):
                if found:
                    words = WORD_BYTES.findall(value.encode())
                    gone = covered(len(words), found).tolist()
                    value = b"".join(w for w, g in zip(words, gone, strict=True) if not g).lstrip(BLANKS).decode()
                out.append(value)
            columns = list(part.columns[:last])
            columns[at] = pa.array(out, pa.string())
            columns[size_at] = pa.array([len(v or "") for v in out], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:last])

    return rows.mapInArrow(run, schema)
