"""Dense ranking over unit vectors and reciprocal-rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Query vectors are handed to every executor up to this number of rows; more are joined partition by partition.
MAX_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors in double, in order of their elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def cosine(vectors: DataFrame, queries: DataFrame, section: str, owner: str, vector: str) -> DataFrame:
    """qid, owner, section, cosine of every section for every stated query (qid, query_vector): a set of queries against all rows."""
    stated = queries.select("qid", F.col("query_vector"))
    few = stated.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES
    rows = vectors.crossJoin(F.broadcast(stated) if few else stated)
    return rows.select("qid", owner, section, dot(F.col(vector), F.col("query_vector")).alias("cosine"))


def best_per_owner(scored: DataFrame, owner: str, section: str) -> DataFrame:
    """qid, owner, section, cosine: each owner's best section, the least section among equals."""
    best = F.max_by(F.struct(F.col(section), F.col("cosine")), F.struct(F.round("cosine", 9), -F.col(section)))
    return scored.groupBy("qid", owner).agg(best.alias("b")).select("qid", owner, f"b.{section}", "b.cosine")


def fresh(vectors: DataFrame, live: DataFrame, path: str, stamp: str) -> DataFrame:
    """Vectors whose document still has the stamp that was embedded."""
    return vectors.join(live, [path, stamp], "left_semi")


def ranked(rows: DataFrame, name: str, key: str, by: list[Column]) -> DataFrame:
    """qid, key, list, rank from one leg."""
    order = Window.partitionBy("qid").orderBy(*by)
    return rows.select("qid", key, F.lit(name).alias("list"), F.row_number().over(order).alias("rank"))


def rrf(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """qid, key, fused: the sum of 1 / (k + rank) over the lists."""
    return reduce(DataFrame.unionByName, lists).groupBy("qid", key).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fused"))
