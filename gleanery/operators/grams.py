"""Many patterns at once: which texts hold which of many strings, by equi-joins on grams instead of a look at every pair.

A pattern is known by its trigrams, three neighbouring bytes of its UTF-8 and where in the pattern they stand; a shorter
pattern is one gram by itself. Of each pattern the CHECKED rarest grams are asked for, rarity by a sample of the texts (it
says how much work is spared and changes no row). A start at which all of a pattern's asked grams stand at their distances
makes a candidate, and the text has the last word on it.

Up to SENT patterns, and SENT_BYTES of them, go to every executor: one pass over the texts finds where the rarest gram of
a pattern stands and looks for its others around that place, so texts and postings stay where they are. Of more patterns
the pass lists where the asked grams stand, known by a bitmap over all grams there are, 2 MB however many patterns. These
postings meet the patterns in an equi-join on the gram, and candidates meet their text again.

Up to FEW patterns are looked for one by one in each text, which then costs less than its grams; the rows are the same.
Case counts. Empty patterns and null texts match nothing. Equal patterns are looked for once, and then match each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from gleanery.functions.arrow import slices
from gleanery.session import materialise, read_bytes

FEW, CHECKED = 32, 3
SENT, SENT_BYTES = 100_000, 32 << 20
#: Pairs of a place and a pattern that a task looks at in one go.
PAIRS = 1 << 20
#: Bytes of texts that the sample holds, about.
SAMPLE_BYTES = 16 << 20
#: Grams are numbered: those of three bytes first, then of two, then of one.
BASE = {3: 0, 2: 1 << 24, 1: (1 << 24) + (1 << 16)}
GRAMS = BASE[1] + (1 << 8)
BUCKET = 1 << 15  # bits of a bucket of Spark's bitmaps


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each ends."""
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return raw, ends[1:] - ends[0]


def numbers(raw: np.ndarray, n: int) -> np.ndarray:
    """The number of the gram of n bytes at each place."""
    found = np.full(max(0, len(raw) - n + 1), BASE[n], np.int32)
    for i in range(n):
        found += raw[i : i + len(found)].astype(np.int32) << 8 * (n - 1 - i)
    return found


def grams_in(texts: pa.Array, sizes: list[int], asked: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """The text, number and place (in bytes) of the asked grams of some sizes, or of all."""
    raw, ends = laid_out(texts)
    starts = np.concatenate([[0], ends[:-1]])
    parts = []
    for n in sizes:
        grams = numbers(raw, n)
        at = np.flatnonzero(asked[grams]) if asked is not None else np.arange(len(grams))
        owner = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[owner]
        owner, at = owner[inside], at[inside]
        parts.append((owner, grams[at], at - starts[owner]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros((3, 0), np.int64))


def offered_by(patterns: DataFrame, pid: str, q: str) -> DataFrame:
    """pid, off, gram: every gram of each pattern and where it stands in it."""
    kind = patterns.schema[pid].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sizes = np.array([min(3, len(x.encode())) for x in part.column(1).to_pylist()])
            for n in (1, 2, 3):
                some = pa.array(np.flatnonzero(sizes == n))
                owner, gram, at = grams_in(part.column(1).take(some), [n], None)
                yield pa.RecordBatch.from_arrays([part.column(0).take(some).take(pa.array(owner)), pa.array(at, pa.int32()), pa.array(gram, pa.int32())], [pid, "off", "gram"])

    return patterns.select(pid, q).where(F.length(q) > 0).mapInArrow(run, f"`{pid}` {kind}, off int, gram int")


def as_bitmap(asked: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Whether each gram is asked for, and the sizes of those that are. The driver reads 513 rows of 4 kB at most."""
    known = np.zeros(-(-GRAMS // BUCKET) * BUCKET, bool)
    n = F.col("gram") + 1
    for r in asked.groupBy(F.bitmap_bucket_number(n).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits")).collect():
        known[(r["b"] - 1) * BUCKET : r["b"] * BUCKET] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return known, [s for s in BASE if known[BASE[s] : BASE[s] + (1 << 8 * s)].any()]


def postings(texts: DataFrame, keys: list[str], text: str, asked: DataFrame) -> DataFrame:
    """keys, gram, at: where the asked grams stand in the texts."""
    known, sizes = as_bitmap(asked)
    packed = texts.sparkSession.sparkContext.broadcast(np.packbits(known))
    n = len(keys)
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed.value).view(bool)
        for part in slices(batches, n):
            owner, gram, at = grams_in(part.column(n), sizes, bits)
            picked = [part.column(i).take(pa.array(owner)) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(gram, pa.int32()), pa.array(at, pa.int32())], [*keys, "gram", "at"])

    return texts.select(*keys, text).mapInArrow(run, f"{kinds}, gram int, at int")


def frequencies(texts: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """gram, n: how often the asked grams stand in the texts."""
    known, sizes = as_bitmap(asked)
    packed = texts.sparkSession.sparkContext.broadcast(np.packbits(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed.value).view(bool)
        for part in slices(batches, 0):
            gram, n = np.unique(grams_in(part.column(0), sizes, bits)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(n, pa.int64())], ["gram", "n"])

    return texts.select(text).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def rarest(texts: DataFrame, text: str, patterns: DataFrame, pid: str, q: str) -> DataFrame:
    """pid, off, gram, asked, nth: the CHECKED grams of each pattern that are rarest in a sample of the texts, how many these are, and which is rarest."""
    offered = materialise(offered_by(patterns, pid, q), "grams-offered")
    sample = texts.sample(min(1.0, SAMPLE_BYTES / max(1, read_bytes(texts))), 7)
    rows = offered.join(frequencies(sample, text, offered), "gram", "left")
    order = Window.partitionBy(pid).orderBy(F.coalesce("n", F.lit(0)), "off")
    rows = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= CHECKED)
    rows = rows.withColumn("asked", F.count(F.lit(1)).over(Window.partitionBy(pid)))
    return materialise(rows.select(pid, "off", "gram", "asked", F.col("_rank").alias("nth")), "grams-asked")


def one_by_one(texts: DataFrame, text: Column, stated: list, kind: DataType, pid: str, q: str) -> DataFrame:
    """holding() for a few patterns (rows of pid and q)."""
    known = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(r[q]).alias("q")) for i, r in enumerate(stated)))
    found = texts.withColumn("_hit", F.explode(F.filter(known, lambda p: F.contains(text, p["q"]))))
    ids = F.array(*(F.lit(r[pid]).cast(kind) for r in stated))
    return found.select(*texts.columns, F.get(ids, F.col("_hit.at")).alias(pid), F.col("_hit.q").alias(q))


def around(texts: DataFrame, text: str, chosen: pa.Table, pid: str, kind: str) -> DataFrame:
    """The columns of texts and pid for texts in which all asked grams of a pattern stand at their distances; chosen (as rarest() has it) goes to every task."""
    chosen = chosen.sort_by([("nth", "ascending")])
    pids = chosen[pid].combine_chunks().unique()
    owner, nth, off, gram = pc.index_in(chosen[pid], value_set=pids).to_numpy(), *(chosen[c].to_numpy() for c in ("nth", "off", "gram"))
    n = int((nth == 1).sum())
    grams = np.repeat(gram[nth == 1][None], CHECKED, axis=0)  # a pattern with fewer grams has its rarest in place of the others
    away = np.zeros((CHECKED, n), np.int64)
    for k in range(1, CHECKED):
        of = owner[nth == k + 1]
        grams[k, of], away[k, of] = gram[nth == k + 1], off[nth == k + 1] - off[:n][of]
    order = np.argsort(grams[0], kind="stable")
    known = np.zeros(GRAMS, bool)
    known[grams[0]] = True
    spark, columns = texts.sparkSession, texts.columns
    shared = spark.sparkContext.broadcast((np.packbits(known), pids.take(pa.array(order)), grams[:, order], away[:, order]))
    sizes = [s for s in BASE if known[BASE[s] : BASE[s] + (1 << 8 * s)].any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, pids, grams, away = shared.value
        bits = np.unpackbits(packed).view(bool)
        for part in slices(batches, columns.index(text)):
            raw, ends = laid_out(part.column(columns.index(text)))
            starts = np.concatenate([[0], ends[:-1]])
            found = [np.zeros(0, np.int64)]
            for size in sizes:
                here = numbers(raw, size)
                places = np.flatnonzero(bits[here])
                row = np.searchsorted(ends, places, side="right")
                inside = places + size <= ends[row]
                places, row = places[inside], row[inside]
                low = np.searchsorted(grams[0], here[places], "left")
                m = np.searchsorted(grams[0], here[places], "right") - low
                total = np.cumsum(m)
                start = 0
                while start < len(places):
                    end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")))
                    some = m[start:end]
                    pattern = np.repeat(low[start:end] - (np.cumsum(some) - some), some) + np.arange(some.sum())
                    at, of = np.repeat(places[start:end], some), np.repeat(row[start:end], some)
                    for k in range(1, len(grams)):
                        there = at + away[k, pattern]
                        fits = (there >= starts[of]) & (there + size <= ends[of])
                        fits[fits] = here[there[fits]] == grams[k, pattern[fits]]
                        at, of, pattern = at[fits], of[fits], pattern[fits]
                    found.append(np.unique(of * len(pids) + pattern))
                    start = end
            found = np.unique(np.concatenate(found))
            rows, first = np.unique(found // len(pids), return_index=True)
            held = pa.ListArray.from_arrays(pa.array(np.append(first, len(found)), pa.int32()), pids.take(pa.array(found % len(pids))))
            yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows)).columns, held], [*columns, "_held"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema), f"_held array<{kind}>"])
    return texts.mapInArrow(run, schema).withColumn(pid, F.explode("_held")).drop("_held")


def by_joins(texts: DataFrame, keys: list[str], text: str, patterns: DataFrame, chosen: DataFrame, pid: str, q: str) -> DataFrame:
    """holding() for any number of patterns and their chosen grams."""
    met = postings(texts, keys, text, chosen).join(chosen, "gram")
    places = met.groupBy(*keys, pid, (F.col("at") - F.col("off")).alias("_start")).agg(F.count(F.lit(1)).alias("_n"), F.first("asked").alias("_asked"))
    candidates = places.where(F.col("_n") == F.col("_asked")).select(*keys, pid).distinct()
    return texts.join(candidates.join(patterns, pid), keys).where(F.contains(text, q)).select(*texts.columns, pid, q)


def holding(texts: DataFrame, keys: list[str], text: str, patterns: DataFrame, pid: str = "qid", q: str = "q", few: int = FEW, sent: int = SENT) -> DataFrame:
    """The columns of texts, pid and q for every text that holds a pattern. keys tell the rows of texts apart, pid those of patterns; neither is null."""
    every = patterns.select(pid, q).where(F.length(q) > 0)
    patterns = every.groupBy(q).agg(F.min(pid).alias(pid)).select(pid, q)  # equal patterns are looked for once
    stated = patterns.limit(few + 1).collect() if few else []
    if few and len(stated) <= few:
        found = one_by_one(texts, F.col(text), stated, patterns.schema[pid].dataType, pid, q) if stated else texts.join(patterns.where("false"), F.lit(False))
    else:
        chosen = rarest(texts, text, patterns, pid, q)
        asked, size = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(q)), F.lit(0))).first()
        if asked <= sent and size <= SENT_BYTES:
            stated = chosen.toArrow()  # CHECKED rows a pattern
            hits = around(texts, text, stated, pid, chosen.schema[pid].dataType.simpleString())
            found = hits.join(F.broadcast(patterns), pid).where(F.contains(text, q)).select(*texts.columns, pid, q)
        else:
            found = by_joins(texts, keys, text, patterns, chosen, pid, q)
    n, classes = every.agg(F.count(F.lit(1)), F.count_distinct(q)).first()
    return found if n == classes else found.drop(pid).join(every, q).select(*texts.columns, pid, q)
