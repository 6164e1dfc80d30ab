"""A quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown level by level on binned features, then flattened: every tree is a complete binary tree in three
arrays, and scoring walks all trees of all rows together with numpy. Learning takes a bounded sample of labelled rows,
chosen by a hash of the key; only their statistics reach the driver. Scoring reads every whole text.

A null text counts as empty. Rows without a label, and labels of unknown documents, teach nothing; with no label at all
the score is 0.5. Equal texts have equal scores. Rows are held out by the CRC-32 of their key as text (null: empty).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.columns import slices

#: Labelled rows to learn from, at most about so many.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LAMBDA, LEAST = 80, 4, 64, 0.15, 1.0, 8.0
THRESHOLD = 0.3

CLASSES = np.zeros((256, 8), np.float64)
for _byte in range(256):
    _char = chr(_byte)
    CLASSES[_byte] = [
        "a" <= _char <= "z", "A" <= _char <= "Z", "0" <= _char <= "9", _byte >= 128, _char == " ", _char == "\n",
        _char in ".,;:!?'\"()-", _byte < 128 and not _char.isalnum() and _byte > 32 and _char not in ".,;:!?'\"()-"]
FEATURES = [
    "log_bytes", "lower", "upper", "digit", "wide", "blank", "newline", "stop", "symbol", "log_words", "word_length",
    "distinct_words", "short_words", "long_words", "bare_words", "ended_words", "top_word", "log_lines", "distinct_lines",
    "top_line", "line_length", "ended_lines", "entropy", "repeated_pairs"]


def statistics(text: str | None) -> list[float]:
    """The numbers of FEATURES for one text."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    share = counts[counts > 0] / n
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    ends = sum(1 for w in words if w[-1:] in b".,;:!?")
    bare = sum(1 for w in seen if not any(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in w))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    k = max(1, len(lines))
    seen_lines = Counter(lines)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(raw)), *(counts @ CLASSES / n).tolist(), np.log1p(len(words)), float(lengths.sum()) / m, len(seen) / m,
        float((lengths <= 3).sum()) / m, float((lengths >= 15).sum()) / m, bare / max(1, len(seen)), ends / m,
        max(seen.values(), default=0) / m, np.log1p(len(lines)), len(seen_lines) / k, max(seen_lines.values(), default=0) / k,
        len(raw) / k, sum(1 for x in lines if x.rstrip()[-1:] in ".!?") / k, float(-(share * np.log2(share)).sum()),
        1 - pairs / max(1, len(words) - 1)]


class Trees:
    """Flattened trees: feature, cut and value arrays, one row a tree."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        raw = np.full(len(x), self.base)
        if len(self.feature):
            tree = np.arange(len(self.feature))
            node = np.zeros((len(x), len(tree)), np.int64)
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
            raw = raw + self.value[tree, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for labels y (0 or 1) of the rows of x, by Newton steps on the logistic loss."""
    inner = 2**DEPTH - 1
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y):
        return none
    mean = float(np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1)))
    none.base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return none
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(width)], axis=1)
    flat = binned + np.arange(width) * BINS
    raw = np.full(len(y), none.base)
    features, cuts, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            size = many * width * BINS
            g = np.bincount(cell, np.repeat(grad, width), size).reshape(many, width, BINS)
            h = np.bincount(cell, np.repeat(hess, width), size).reshape(many, width, BINS)
            gl, hl = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            gt, ht = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
            gain = gl**2 / (hl + LAMBDA) + (gt - gl) ** 2 / (ht - hl + LAMBDA) - gt**2 / (ht + LAMBDA)
            gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = -1.0
            best = gain.reshape(many, -1).argmax(axis=1)
            at_bin = np.full(many, BINS)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS - 1)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], cut[first + k], at_bin[k] = f, edges[f][b], b
            local = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > at_bin[local])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + LAMBDA)
        raw += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(none.base, np.stack(features), np.stack(cuts), np.stack(values))


def with_statistics(docs: DataFrame, *names: str, text: str = "text") -> DataFrame:
    """The named columns and the statistics (array of double) of every row."""
    source = docs.select(*(docs[n] for n in names), docs[text].alias("_text"))
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            found = pa.array([statistics(t) for t in part.column(at).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:at], found], [*names, "statistics"])

    kinds = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    return source.mapInArrow(run, f"{kinds}, statistics array<double>")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = TRAIN_ROWS) -> Trees:
    """Trees from the labelled documents; about bound labels, chosen by a hash of their key, are used."""
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where("label IN (0, 1) AND key IS NOT NULL")
    n = known.count()
    scale = 1 << 20
    known = known.where(F.pmod(F.xxhash64(F.lit("quality"), "key"), F.lit(scale)) < min(scale, -(-bound * scale // max(1, n))))
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(F.broadcast(known), "key")  # about bound rows
    found = with_statistics(rows, "key", "label").orderBy("key", "label").select("label", "statistics").collect()
    x = np.array([r["statistics"] for r in found]).reshape(len(found), len(FEATURES))
    return grow(x, np.array([float(r["label"]) for r in found]))


def score(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted (1 from THRESHOLD on) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[key], docs[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for part in slices(batches, 1):
            value = trees.score(np.array([statistics(t) for t in part.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], [key, "score", "predicted"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, score double, predicted int")
