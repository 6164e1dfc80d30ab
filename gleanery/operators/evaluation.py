"""Retrieval quality: nDCG, MRR and recall at k, paired bootstrap, hits on files and line spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """run (qid, doc, rank) with rel, 0 for unjudged documents."""
    return run.join(qrels.select("qid", doc, "rel"), ["qid", doc], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def added(parts: Column) -> Column:
    """The sum of a group's few numbers from the least on: equal numbers give equal sums, in whatever order they come."""
    return F.aggregate(F.sort_array(F.collect_list(parts)), F.lit(0.0), lambda a, x: a + x)


def metrics(run: DataFrame, qrels: DataFrame, k: int = 10, doc: str = "doc_id") -> DataFrame:
    """qid, ndcg, mrr, recall of every query that has a relevant document."""
    hits = judged(run.where(F.col("rank") <= k), qrels, doc).where("rel > 0")
    got = hits.groupBy("qid").agg(
        added(F.col("rel") / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"), F.max(1.0 / F.col("rank")).alias("rr"), F.count(F.lit(1)).alias("found"))
    order = Window.partitionBy("qid").orderBy(F.desc("rel"), doc)
    ideal = qrels.where("rel > 0").withColumn("_i", F.row_number().over(order))
    best = ideal.groupBy("qid").agg(
        added(F.when(F.col("_i") <= k, F.col("rel") / F.log2(F.col("_i") + F.lit(1.0)))).alias("idcg"), F.count(F.lit(1)).alias("relevant"))
    rows = best.join(got, "qid", "left")
    return rows.select(
        "qid", F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"), F.coalesce("rr", F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("found") / F.col("relevant"), F.lit(0.0)).alias("recall"))


def paired_bootstrap(a: DataFrame, b: DataFrame, metric: str, resamples: int = 4_000, seed: int = 7) -> DataFrame:
    """One row: mean gain of a over b, its 2.5 and 97.5 percentiles over resamples, wins, losses, ties.

    A resample draws as many queries as there are, with replacement; each draw is a hash of the seed, the resample and
    its number, so reruns agree. Queries are numbered in one task: there is one row for each judged query.
    """
    pair = a.select("qid", F.col(metric).alias("x")).join(b.select("qid", F.col(metric).alias("y")), "qid").select("qid", (F.col("x") - F.col("y")).alias("d"))
    pair = pair.withColumn("at", F.row_number().over(Window.orderBy("qid")) - 1)
    n = pair.count()
    spark = pair.sparkSession
    draw = spark.range(resamples * n).select(F.floor(F.col("id") / max(n, 1)).alias("r"), (F.col("id") % max(n, 1)).alias("j"))
    number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), "r", "j").cast("binary")), 1, 15), 16, 10).cast("long")
    draw = draw.select("r", (number % max(n, 1)).cast("int").alias("at"))
    means = draw.join(pair.select("at", "d"), "at").groupBy("r").agg(F.avg("d").alias("m"))
    band = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    whole = pair.agg(F.avg("d").alias("gain"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"), F.count_if(F.col("d") == 0).alias("ties"))
    return whole.crossJoin(band)  # one row each


def code_hits(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """task_id, file_hit, symbol_hit, rr, recall, symbol_recall: hits (task_id, file, start, end, anchor, rank) against gold (task_id, file, start, end).

    Files count once each, in order of their first hit among the first k. A gold span is located by a hit in its file
    whose anchor lies inside, or that overlaps it and is no longer than three times the span and ten lines more. Gold
    rows without a span count for files only; symbol columns are null where a task has no span.
    """
    first = hits.where(F.col("rank") <= k)
    order = Window.partitionBy("task_id").orderBy("first_rank", "file")
    files = first.groupBy("task_id", "file").agg(F.min("rank").alias("first_rank")).withColumn("file_rank", F.row_number().over(order))
    wanted = gold.select("task_id", "file").distinct()
    found = files.join(wanted, ["task_id", "file"]).groupBy("task_id").agg(F.min("file_rank").alias("first"), F.count(F.lit(1)).alias("n"))
    spans = gold.where("start IS NOT NULL").select("task_id", "file", F.col("start").alias("s"), F.col("end").alias("e")).distinct()
    near = first.join(spans, ["task_id", "file"]).where(
        "anchor BETWEEN s AND e OR (end >= s AND start <= e AND end - start + 1 <= 3 * (e - s + 1) + 10)")
    located = near.select("task_id", "file", "s", "e").distinct().groupBy("task_id").agg(F.count(F.lit(1)).alias("l"))
    symbols = spans.groupBy("task_id").agg(F.count(F.lit(1)).alias("t")).join(located, "task_id", "left")
    rows = wanted.groupBy("task_id").agg(F.count(F.lit(1)).alias("g")).join(found, "task_id", "left").join(symbols, "task_id", "left")
    share = F.when(F.col("t").isNotNull(), F.coalesce(F.col("l"), F.lit(0)) / F.col("t"))
    return rows.select("task_id", F.col("first").isNotNull().alias("file_hit"), (share > 0).alias("symbol_hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
                       F.coalesce(F.col("n") / F.col("g"), F.lit(0.0)).alias("recall"), share.alias("symbol_recall"))


def means(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))
