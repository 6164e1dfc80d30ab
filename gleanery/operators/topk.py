"""The k best documents of many queries without reading all postings: blocks with their greatest score, a threshold first.

Postings of a term stand in blocks by bucket of the document (neighbours in the stored index, so that blocks are made where
the documents lie); a block knows the greatest part that any document of it can add. A query's terms are ordered by what they can add at most. The first few give partial scores, and
the k-th of these is a score that k documents reach. Terms at the end of the order that can't reach it even together are
not essential: a document that holds only such terms can't be among the best, so their postings are not read as such.
The documents of the essential terms get partial scores; those that still can't reach the k-th of them with all the rest
added go. For the few that stay, the blocks of the other terms in their buckets alone are read, and of these only blocks
whose greatest part can still matter.

The rows are those of lexical.score() and a sort. An index without documents, or a query without known terms, gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.lexical import SLACK, Index, part_of, small, unfolded
from gleanery.session import materialise, release

#: Documents of a bucket at most; postings that the first threshold is drawn from, for each wanted document.
BUCKET_DOCS, SEED_DOCS = 128, 20


@dataclass
class Blocks:
    """table (term, bucket, most, posts: array of key and part) and terms (term, df, best)."""

    key: str
    table: DataFrame
    terms: DataFrame


def blocks(ix: Index) -> Blocks:
    """The postings of an index in blocks, written to the shared folder; a task makes those of the documents it reads, in order of terms."""
    _, avgdl = ix.stats.select("n", "avgdl").first()
    each = BUCKET_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId() << 33
        for batch in batches:
            owner, terms, tf, dl = unfolded(batch)
            if not len(owner):
                continue
            terms = terms.dictionary_encode()
            order = pc.sort_indices(terms.dictionary)
            rank = np.argsort(order.to_numpy())
            code = rank[terms.indices.to_numpy()]
            by = np.lexsort((owner, code))
            code, owner = code[by], owner[by]
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]))
            part = np.add.reduceat(part_of(tf, dl, avgdl, 1.0)[by], first)  # a document has a term once, unless it has several rows
            code, owner = code[first], owner[first]
            place = owner // each
            start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (place[1:] != place[:-1])]))
            posts = pa.StructArray.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(part)], ["key", "part"])
            yield pa.RecordBatch.from_arrays(
                [terms.dictionary.take(order).take(pa.array(code[start])), pa.array(place[start] + bucket), pa.array(np.maximum.reduceat(part, start)),
                 pa.ListArray.from_arrays(pa.array(np.append(start, len(part)), pa.int32()), posts)], ["term", "bucket", "most", "posts"])
            bucket += -(-batch.num_rows // each)

    kind = ix.whole.schema[ix.key].dataType.simpleString()
    table = materialise(ix.whole.mapInArrow(run, f"term string, bucket long, most double, posts array<struct<key: {kind}, part: double>>"), "blocks")
    terms = materialise(table.groupBy("term").agg(F.sum(F.size("posts")).alias("df"), F.max("most").alias("best")), "block-terms")
    return Blocks(ix.key, table, terms)


def ordered(known: Blocks, weights: DataFrame) -> DataFrame:
    """qid, term, idf, gain (what the term can add), before (postings of the terms ahead of it) and rest (what it and those after it can add)."""
    rows = weights.where("df > 0").select("qid", "term", "idf").join(known.terms, "term")
    rows = rows.withColumn("gain", F.col("idf") * F.col("best"))
    order = Window.partitionBy("qid").orderBy(F.desc("gain"), "term")
    return rows.select("qid", "term", "idf", "gain", F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                       F.sum("gain").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))


def partial(known: Blocks, terms: DataFrame) -> DataFrame:
    """qid, key, bucket, score: what the terms (qid, term, idf) add to the documents that hold them."""
    rows = known.table.join(small(terms.select("qid", "term", "idf")), "term").select("qid", "idf", "bucket", F.explode("posts").alias("p"))
    return rows.groupBy("qid", "p.key", "bucket").agg(F.sum(F.col("idf") * F.col("p.part")).alias("score"))


def reached(scores: DataFrame, k: int) -> DataFrame:
    """qid, reach: the k-th greatest score, for queries that have so many."""
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    return scores.select("qid", "score", nth.alias("n")).where(F.col("n") == k).select("qid", F.col("score").alias("reach"))


def top_k(known: Blocks, weights: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """qid, key and score of all documents that may be among the k best of a query, and qid, term, bucket of the blocks read for them."""
    terms = materialise(ordered(known, weights), "ordered-terms")
    no_reach = F.coalesce("reach", F.lit(float("-inf")))
    seeds = reached(partial(known, terms.where(F.col("before") < SEED_DOCS * k)), k)
    split = materialise(terms.join(seeds, "qid", "left").withColumn("essential", F.col("rest") + SLACK >= no_reach).drop("reach"), "split-terms")
    release(terms)
    first = split.where("essential")
    scores = materialise(partial(known, first), "partial-scores")
    more = split.where("NOT essential")
    left = more.groupBy("qid").agg(F.sum("gain").alias("left"))
    stay = scores.join(reached(scores, k), "qid", "left").join(left, "qid", "left")
    stay = stay.where(F.col("score") + F.coalesce("left", F.lit(0.0)) + SLACK >= no_reach)
    stay = materialise(stay.select("qid", "key", "score", "reach", "left", "bucket"), "candidates")
    # A block matters to a document only if the document, with all other terms at their most and this one at the block's, reaches the threshold.
    least = no_reach - F.col("score") - F.col("left") + F.col("gain") - SLACK
    asked = stay.join(more.select("qid", "term", "idf", "gain"), "qid").select("qid", "key", "term", "bucket", "idf", least.alias("least"))
    table = known.table.join(small(more.select("term").distinct()), "term", "left_semi")  # only these terms' blocks are looked at
    asked = asked.join(table.select("term", "bucket", "most"), ["term", "bucket"]).where(F.col("idf") * F.col("most") >= F.col("least"))
    asked = materialise(asked.select("qid", "key", "term", "bucket", "idf"), "asked-blocks")
    posts = table.join(asked.select("term", "bucket").distinct(), ["term", "bucket"], "left_semi").select("term", F.explode("posts").alias("p"))
    added = asked.join(posts.select("term", "p.key", "p.part"), ["term", "key"]).select("qid", "key", (F.col("idf") * F.col("part")).alias("score"))
    found = stay.select("qid", "key", "score").unionByName(added).groupBy("qid", "key").agg(F.sum("score").alias("score"))
    read = known.table.select("term", "bucket").join(first.select("qid", "term"), "term").select("qid", "term", "bucket")
    return found.withColumnRenamed("key", known.key), read.unionByName(asked.select("qid", "term", "bucket").distinct())
