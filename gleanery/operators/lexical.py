"""Lexical retrieval: an inverted index, BM25 over documents and sections, coverage and absent terms.

Queries are data: a table (qid, term) of distinct terms. They are handed to every executor only up to MAX_QUERY_TERMS
rows; more of them meet the postings in an ordinary join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import units
from gleanery.session import materialise

K1, B = 1.5, 0.75
MAX_QUERY_TERMS = 200_000
#: What a task scores at a time: pairs of a posting and a query that asks for it, and of a document and a query. What rounding may take.
PAIRS, CELLS, SLACK = 1 << 20, 1 << 21, 2e-6


def small(frame: DataFrame, rows: int = MAX_QUERY_TERMS) -> DataFrame:
    """frame with a broadcast hint if it has no more than so many rows."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def idf_of(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_of(tf: Column, dl: Column, avgdl: Column, idf: Column) -> Column:
    norm = F.lit(1 - B) + F.lit(B) * F.when(dl == 0, 1).otherwise(dl) / avgdl
    return idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * norm)


@dataclass
class Index:
    """postings (key, dl, term, tf), documents (key, dl), frequencies (term, df) and stats (n, avgdl) of one corpus.

    Where they are stored by document, whole has one row a key: key, terms (an array of term, tf), and for each stored row
    of that key, which is one as a rule, its dl and its number n of terms.
    """

    key: str
    postings: DataFrame
    documents: DataFrame
    frequencies: DataFrame
    stats: DataFrame
    whole: DataFrame | None = None


def index(docs: DataFrame, key: str, tokens: Column) -> Index:
    """The index of docs: each text is cut into tokens once, and counts, lengths and frequencies are stored, whatever reads them."""
    counted = materialise(units.counted(docs, [key], tokens), "counted")
    postings = units.exploded(counted, [key])
    postings.stored_at = counted.stored_at
    frequencies = materialise(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    n, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    stats = docs.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total / max(n, 1)).alias("avgdl"))
    whole = counted.select(key, "terms", F.array("dl").alias("dl"), F.array(F.coalesce(F.array_size("terms"), F.lit(0))).alias("n"))
    if counted.select(key).distinct().count() < n:  # rows of one key are one document
        same = F.collect_list(F.struct("terms", F.col("dl")[0].alias("dl"), F.col("n")[0].alias("n")))
        whole = whole.groupBy(key).agg(same.alias("s")).select(key, F.flatten(F.filter("s.terms", F.isnotnull)).alias("terms"), F.col("s.dl").alias("dl"), F.col("s.n").alias("n"))
    return Index(key, postings, counted.select(key, "dl"), frequencies, stats, whole)


def unfolded(rows: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The row, term, tf and dl of each of the terms of some rows of Index.whole."""
    terms, dl, n = rows.column(1), rows.column(2).flatten().to_numpy(), rows.column(3).flatten().to_numpy()
    flat = terms.flatten()
    owner = np.repeat(np.arange(len(terms)), pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
    return owner, flat.field(0), flat.field(1).to_numpy().astype(float), np.repeat(dl, n).astype(float)


def part_of(tf: np.ndarray, dl: np.ndarray, avgdl: float, idf: np.ndarray | float) -> np.ndarray:
    """bm25_of() in numpy."""
    norm = (1 - B) + B * np.where(dl == 0, 1, dl) / avgdl
    return idf * tf * (K1 + 1) / (tf + K1 * norm)


def query_terms(queries: DataFrame, qid: str, tokens: Column) -> DataFrame:
    """qid, term: the distinct terms of every query."""
    return queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(tokens)).alias("term"))


def weigh(ix: Index, terms: DataFrame) -> DataFrame:
    """qid, term, df, idf: df 0 for terms that the corpus lacks, which then weigh most.

    There is a row for each row of terms, so their number alone, checked without a pass over the corpus, says whether the
    result is handed to every executor; the hint stays with it through filters and projections.
    """
    few = terms.limit(MAX_QUERY_TERMS + 1).count() <= MAX_QUERY_TERMS
    known = terms.select("term").distinct()
    found = ix.frequencies.join(F.broadcast(known) if few else known, "term", "left_semi")
    rows = terms.join(found, "term", "left").crossJoin(F.broadcast(ix.stats))  # one row
    df = F.coalesce("df", F.lit(0))
    rows = rows.select("qid", "term", df.alias("df"), idf_of(F.col("n"), df).alias("idf"))
    return F.broadcast(rows) if few else rows


def score(ix: Index, weights: DataFrame, best: int | None = None, signals: bool = True) -> DataFrame:
    """qid, key, score, matched (sorted terms), mass: BM25 of every document that holds a query term.

    With best only rows that may be among a query's so many best, with score to six digits, are sure to be there, and all
    of them are; with best or without signals only qid, key and score are. Up to MAX_QUERY_TERMS weights go to every
    executor, and a document stored in one row is then scored in its task: nothing is shuffled or held for all documents.
    """
    known = weights.where("df > 0")
    if ix.whole is not None:
        stated = known.select("qid", "term", "idf").limit(MAX_QUERY_TERMS + 1).toArrow()
        if stated.num_rows <= MAX_QUERY_TERMS:
            return scored_by_row(ix, stated, known.schema["qid"].dataType.simpleString(), best, signals and best is None)
    rows = ix.postings.join(known, "term").crossJoin(F.broadcast(ix.stats.select("avgdl")))
    part = bm25_of(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))
    return rows.groupBy("qid", ix.key).agg(
        F.sum(part).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"), F.sum("idf").alias("mass"))


def scored_by_row(ix: Index, stated: pa.Table, qid_type: str, best: int | None, signals: bool) -> DataFrame:
    """score() by weights (qid, term, idf) that go to every task, a few documents at a time."""
    qids = stated["qid"].combine_chunks().unique()
    vocabulary = stated["term"].combine_chunks().unique()
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary))  # so terms come in order of their numbers
    term = pc.index_in(stated["term"], value_set=vocabulary).to_numpy()
    order = np.argsort(term, kind="stable")
    first = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))  # where the queries of each term stand
    asks, idfs = pc.index_in(stated["qid"], value_set=qids).to_numpy()[order].astype(np.int64), stated["idf"].to_numpy()[order]
    _, avgdl = ix.stats.select("n", "avgdl").first()
    spark, key = ix.whole.sparkSession, ix.key
    shared = spark.sparkContext.broadcast((qids, vocabulary, first, asks, idfs))
    names = ["qid", key, "score", "matched", "mass"][: 5 if signals else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vocabulary, first, asks, idfs = shared.value
        n_asked = len(qids)
        for batch in batches:
            rows = batch.num_rows
            owner, terms, tf, dl = unfolded(batch)
            code = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy()
            hit = np.flatnonzero(code >= 0)
            owner, code, tf, dl = owner[hit], code[hit], tf[hit], dl[hit]
            asked = first[code + 1] - first[code]
            ends = np.cumsum(np.bincount(owner, asked, rows).astype(np.int64))
            start = 0
            while start < rows and n_asked:
                before = ends[start - 1] if start else 0
                end = min(rows, start + max(1, CELLS // n_asked), max(start + 1, int(np.searchsorted(ends, before + PAIRS, "right"))))
                a, b = np.searchsorted(owner, [start, end])
                m = asked[a:b]
                at = np.repeat(first[code[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                part = part_of(np.repeat(tf[a:b], m), np.repeat(dl[a:b], m), avgdl, idfs[at])
                cell, cells = np.repeat(owner[a:b] - start, m) * n_asked + asks[at], (end - start) * n_asked
                keep = np.bincount(cell, minlength=cells) > 0
                score = np.bincount(cell, part, cells)
                if best is not None and end - start > best:
                    table = np.where(keep, score, -np.inf).reshape(end - start, n_asked)
                    least = np.partition(table, len(table) - best, axis=0)[len(table) - best]
                    keep &= (table >= least - SLACK).ravel()
                kept = np.flatnonzero(keep)
                found = [qids.take(pa.array(kept % n_asked)), batch.column(0).take(pa.array(kept // n_asked + start)), pa.array(score[kept], pa.float64())]
                if signals:
                    by = np.lexsort((number := np.repeat(code[a:b], m), cell))
                    number, place = number[by], cell[by]
                    new = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (place[1:] != place[:-1])])[: len(by)])
                    offsets = np.searchsorted(place[new], np.append(kept, cells))
                    found.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), vocabulary.take(pa.array(number[new]))))
                    found.append(pa.array(np.bincount(cell, idfs[at], cells)[kept], pa.float64()))
                yield pa.RecordBatch.from_arrays(found, names)
                start = end

    kinds = [qid_type, ix.whole.schema[key].dataType.simpleString(), "double", "array<string>", "double"]
    return ix.whole.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=False)))


def query_mass(weights: DataFrame) -> DataFrame:
    """qid, mass_all: what coverage is a share of, absent terms at their df 0 weight."""
    return weights.groupBy("qid").agg(F.sum("idf").alias("mass_all"))


def coverage(matched: Column, whole: Column) -> Column:
    return matched / F.when(whole == 0, 1.0).otherwise(whole)


def absent(weights: DataFrame) -> DataFrame:
    """qid, absent: the sorted terms of a query that no document holds."""
    missing = F.array_sort(F.collect_list(F.when(F.col("df") == 0, F.col("term"))))
    return weights.groupBy("qid").agg(missing.alias("absent"))


def absent_in_scope(ix: Index, weights: DataFrame, scope: DataFrame) -> DataFrame:
    """qid, absent_in_scope: known terms that no document of scope (a table of keys) holds."""
    inside = ix.postings.join(scope, ix.key, "left_semi").select("term").distinct()
    missing = weights.where("df > 0").join(inside, "term", "left_anti")
    found = missing.groupBy("qid").agg(F.array_sort(F.collect_list("term")).alias("absent_in_scope"))
    return weights.select("qid").distinct().join(found, "qid", "left").select("qid", F.coalesce("absent_in_scope", F.array().cast("array<string>")).alias("absent_in_scope"))


def top(scored: DataFrame, k: int, by: list[Column], within: str = "qid") -> DataFrame:
    """The first k rows of each query with their rank."""
    order = Window.partitionBy(within).orderBy(*by)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pool_size(k: int) -> int:
    return max(3 * k, 10)


def score_sections(section_terms: DataFrame, pool: DataFrame, weights: DataFrame, keys: list[str], lengths: DataFrame | None = None) -> DataFrame:
    """qid, keys, score, matched, mass of the sections (keys, dl, term, tf) in each query's pool (qid and the first key).

    The weight of a term is the corpus's, the average length that of the sections in the query's pool: of lengths (keys,
    dl), or of the sections that section_terms has.
    """
    owner = keys[0]
    wanted = pool.select("qid", owner)
    lengths = section_terms.select(*keys, "dl").distinct() if lengths is None else lengths
    pooled = lengths.join(wanted, owner)
    mean = pooled.groupBy("qid").agg(F.avg("dl").alias("pool_avgdl"))
    known = weights.where("df > 0")
    rows = section_terms.join(known, "term").join(wanted, ["qid", owner]).join(mean, "qid")
    average = F.when(F.col("pool_avgdl") > 0, F.col("pool_avgdl")).otherwise(1.0)
    part = bm25_of(F.col("tf"), F.col("dl"), average, F.col("idf"))
    return rows.groupBy("qid", *keys).agg(F.sum(part).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"), F.sum("idf").alias("mass"))


def cap(ranked: DataFrame, owner: str, per_owner: int, k: int, by: list[Column]) -> DataFrame:
    """At most per_owner rows of one owner and k rows of one query, in the given order."""
    each = Window.partitionBy("qid", owner).orderBy(*by)
    return top(ranked.withColumn("_nth", F.row_number().over(each)).where(F.col("_nth") <= per_owner).drop("_nth"), k, by)
