"""Language identification as mixture inference.

A text is lower-cased and cut into its runs of letters; its n-grams of GRAM bytes, hashed into BUCKETS, are taken as
drawn from a mixture of the learned languages' n-gram distributions. Expectation-maximisation estimates the proportions
of all of them. The set of languages is chosen by the likelihood less a penalty for each further language: from the
single most likely one, that language joins which raises it most, and members that no longer pay go. The prediction is
the language with the largest proportion in the chosen set, of equal ones the first by name; the score is its proportion
in the mixture over all learned languages.

A null text and a text without a letter are UNKNOWN with score 0. So is every text where nothing could be learned.
Texts of other languages than those learned still get the least unlikely one; the filter alone drops them. Whole texts are
read, however long; equal texts get equal answers; a null key counts as the empty text when rows are held out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.columns import slices

GRAM, BUCKETS = 4, 1 << 14
UNKNOWN = "und"
#: Learning reads at most about so many documents of a language, chosen by a hash of their key: enough for its n-grams.
TRAIN_DOCS = 4_000
#: EM goes on until no proportion moves by MOVED; cost of a language in log units for each log n-gram.
MOVED, PENALTY = 1e-3, 6.0
#: How much less likely than an even draw, in log units, the n-grams of a text of no learned language are at least.
FOREIGN = 1.5
LETTER = regex.compile(r"\p{L}")
#: Bytes that belong to a letter: a-z and all parts of characters outside ASCII.
IS_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def grams(text: str) -> np.ndarray:
    """Bucket numbers of a text's n-grams, with one blank after each run of letters and three before the first."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    letter = IS_LETTER[raw]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first character after a run stands for the gap
    kept[0] = True
    codes = np.concatenate([[32, 32], np.where(letter, raw, 32)[kept]]).astype(np.uint32)
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value = np.zeros(n, np.uint32)
    for i in range(GRAM):
        value = value * np.uint32(0x01000193) + codes[i : i + n] * np.uint32(0x9E3779B1)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x85EBCA6B)
    return (value >> np.uint32(32 - 14)).astype(np.int64)


class Mixture:
    """The learned languages and how a text is judged by them."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        smooth = counts + 0.05
        self.table = (smooth / smooth.sum(axis=0)).astype(np.float32)  # bucket x language

    def fit(self, weights: np.ndarray, likely: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
        """Proportions of the columns of likely (n-gram x language), the log likelihood reached, and each n-gram's."""
        total = weights.sum()
        share = np.full(likely.shape[1], 1 / likely.shape[1]) if share is None else share
        while True:
            whole = likely @ share
            new = share * ((weights / whole) @ likely) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < MOVED:
                break
        whole = likely @ share
        return share, float(weights @ np.log(whole)), whole

    def choose(self, weights: np.ndarray, likely: np.ndarray, alone: np.ndarray, cost: float, most_likely: float) -> tuple[list[int], np.ndarray, float]:
        """The set of columns of likely with the greatest penalised likelihood that single additions and removals find.

        Likelihood is concave in the proportions, so its slope towards a language bounds what adding it can gain, and
        most_likely bounds that of all languages together: those that can't pay their cost aren't tried, and no other
        bound on their number or share is needed.
        """
        chosen = [int(alone.argmax())]
        parts, reached, whole = np.ones(1), float(alone[chosen[0]]), likely[:, chosen[0]]
        total = weights.sum()
        while reached + cost < most_likely:
            slope = (weights / whole) @ likely
            most = np.maximum(slope, slope[chosen].max()) - total  # what a mixture of the set and one more can gain
            tried = [(self.fit(weights, likely[:, [*chosen, i]], np.append(parts * 0.9, 0.1)), i) for i in np.flatnonzero(most > cost).tolist() if i not in chosen]
            if not tried:
                break
            (new, best, mix), i = max(tried, key=lambda t: (t[0][1], -t[1]))
            if best - cost <= reached:
                break
            chosen, parts, reached, whole = [*chosen, i], new, best, mix
            while len(chosen) > 2:  # an earlier one may not pay any more
                left = [(self.fit(weights, likely[:, chosen[:k] + chosen[k + 1 :]]), k) for k in range(len(chosen) - 1)]
                (new, best, mix), k = max(left, key=lambda t: (t[0][1], -t[1]))
                if best + cost < reached:
                    break
                chosen, parts, reached, whole = chosen[:k] + chosen[k + 1 :], new, best, mix
        return chosen, parts, reached

    def judge(self, text: str | None) -> tuple[str, float, list[tuple[str, float]], float]:
        """The language, its score, the chosen set with proportions, and the evidence that the text is of them.

        The evidence is the log likelihood above that of a background whose n-grams are FOREIGN log units each less
        likely than drawn evenly from all buckets, and the cost of a language more.
        """
        if not self.names or not text or not LETTER.search(text):
            return UNKNOWN, 0.0, [], 0.0
        counts = np.bincount(grams(text), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        if not len(at):
            return UNKNOWN, 0.0, [], 0.0
        weights, likely = counts[at].astype(np.float64), self.table[at].astype(np.float64)
        alone = weights @ np.log(likely)
        share, full, whole = self.fit(weights, likely)
        most = full + float(((weights / whole) @ likely).max() - weights.sum())
        cost = PENALTY * np.log(max(2.0, weights.sum()))
        chosen, parts, reached = self.choose(weights, likely, alone, cost, most)
        top = max(range(len(chosen)), key=lambda k: (parts[k], -chosen[k]))
        found = [(self.names[c], float(p)) for c, p in zip(chosen, parts, strict=True)]
        return found[top][0], float(min(1.0, max(0.0, share[chosen[top]]))), found, float(reached + weights.sum() * (np.log(BUCKETS) + FOREIGN) + cost)


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", bound: int = TRAIN_DOCS) -> Mixture:
    """A model from the rows' texts and non-null languages: about bound documents of each, all of rarer ones."""
    labelled = rows.select(rows[key].alias("key"), rows[text].alias("text"), rows[lang].alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in counted.collect()}  # the world has about 7,000 languages
    names = sorted(sizes)
    if not names:
        return Mixture([], np.zeros((BUCKETS, 0)))
    scale = 1 << 20
    limits = F.from_json(F.lit(json.dumps({n: -(-bound * scale // sizes[n]) for n in names if sizes[n] > bound})), "map<string,bigint>")
    limit = F.coalesce(F.try_element_at(limits, F.col("lang")), F.lit(scale))
    sample = labelled.where(F.pmod(F.xxhash64(F.lit("language"), "key"), F.lit(scale)) < limit).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part in slices(batches, 1):
            for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                one = np.bincount(grams(value), minlength=BUCKETS)
                held[name] = held[name] + one if name in held else one
        for name, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((BUCKETS, len(names)))
    place = {n: i for i, n in enumerate(names)}
    for r in counted.toLocalIterator():  # BUCKETS rows a language at most
        counts[r["bucket"], place[r["lang"]]] = r["n"]
    return Mixture(names, counts)


def identify(docs: DataFrame, model: Mixture, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, and mixture (the chosen languages with their proportions) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[key], docs[text])
    names = [key, "lang_pred", "score", "mixture"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = shared.value
        kind = pa.map_(pa.string(), pa.float64())
        for part in slices(batches, 1):
            rows = [mixture.judge(t) for t in part.column(1).to_pylist()]
            lang, score, found, _ = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(found, kind)], names)

    own = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"{key} {own}, lang_pred string, score double, mixture map<string,double>")


def keep_identified(docs: DataFrame, model: Mixture, least: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose language is known with a score of least or more, lang set to the prediction.

    Texts that a background explains better than any mixture of learned languages go too: other scripts, other
    languages, random letters. A text of a few words gives too little evidence for that and stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, place, at = docs.schema, docs.columns.index(text), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = shared.value
        for part in slices(batches, place):
            rows = [mixture.judge(t) for t in part.column(place).to_pylist()]
            kept = pa.array([lang != UNKNOWN and score >= least and evidence >= 0 for lang, score, _, evidence in rows], pa.bool_())
            part = part.set_column(at, part.schema.names[at], pa.array([r[0] for r in rows], pa.string()))
            yield part.filter(kept)

    return docs.mapInArrow(run, schema)
