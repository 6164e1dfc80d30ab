"""Files beside notes: which note embeds or documents which file; and ranking by a walk over typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import markdown
from gleanery.functions.arrow import generate


def references(notes: DataFrame) -> DataFrame:
    """src, target, kind: embed for files in the text, documents for those that the frontmatter names."""

    def one(text):
        return [(t, "embed") for k, t, _ in markdown.link_rows(text) if k == "file"] + [(t, "documents") for t in markdown.documents(text)]

    return generate(notes, ["path"], ["text"], one, [("target", "string"), ("kind", "string")]).withColumnRenamed("path", "src")


def resolve(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """src, target, kind, asset: a file by its whole path or the end of it; the one nearest to the note, then the shallowest."""
    parts = F.split(F.lower("path"), "/")
    tails = assets.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))).alias("tail"))
    wanted = F.lower(F.regexp_replace("target", r"^(\./)+", ""))
    found = refs.withColumn("_w", wanted).join(tails, F.col("_w") == F.col("tail"))
    folder = F.regexp_extract("src", r"^(.*/)?[^/]*$", 1)
    order = Window.partitionBy("src", "target", "kind").orderBy(F.when(F.startswith("path", folder), 0).otherwise(1), F.size(F.split("path", "/")), F.lower("path"), "path")
    best = found.withColumn("_o", F.row_number().over(order)).where("_o = 1").select("src", "target", "kind", F.col("path").alias("asset"))
    return refs.join(best, ["src", "target", "kind"], "left")


def backlinks(resolved: DataFrame) -> DataFrame:
    """asset, src, kind."""
    return resolved.where("asset IS NOT NULL").select("asset", "src", "kind").distinct()


#: What a node's score is multiplied by where its name shares a term with the query.
NAMED = 1.5


def expand(seeds: DataFrame, edges: DataFrame, weights: dict[str, float], hops: int = 2, decay: float = 0.5, fan: int = 50, k: int = 60, asked: DataFrame | None = None) -> DataFrame:
    """qid, node, score: seeds (qid, node, rank) spread over edges (src, dst, kind), at most fan edges of a kind from a node and hop.

    A step's weight is the kind's over k + rank, less by decay a hop and by the logarithm of the target's in-degree. With
    asked (qid, terms) a node whose name (the last part of its path, cut into words) has one of the terms scores NAMED
    times as much.
    """
    w = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    degree = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).select(F.col("dst").alias("node"), F.log2(1.0 + F.col("n")).alias("damp"))
    order = Window.partitionBy("src", "kind").orderBy("dst")
    limited = edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fan).drop("_n")
    reached = seeds.select("qid", "node", F.lit(1.0).alias("share"), "rank", F.lit(0).alias("hop"))
    whole = reached
    for hop in range(1, hops + 1):
        step = reached.join(limited, reached["node"] == limited["src"]).select(
            "qid", F.col("dst").alias("node"), (F.coalesce(w[F.col("kind")], F.lit(0.0)) * (F.lit(decay) ** (hop - 1))).alias("share"), "rank", F.lit(hop).alias("hop"))
        reached = step.groupBy("qid", "node", "hop").agg(F.max("share").alias("share"), F.min("rank").alias("rank")).select("qid", "node", "share", "rank", "hop")
        whole = whole.unionByName(reached)
    scored = whole.join(degree, "node", "left").withColumn("part", F.col("share") / (k + F.col("rank")) / (1.0 + F.coalesce("damp", F.lit(0.0))))
    found = scored.groupBy("qid", "node").agg(F.sum("part").alias("score"))
    if asked is None:
        return found
    name = F.filter(F.split(F.lower(F.regexp_extract(F.col("node").cast("string"), r"([^/]*?)(?:\.[^./]*)?$", 1)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    factor = F.when(F.arrays_overlap(name, F.coalesce("terms", F.array().cast("array<string>"))), NAMED).otherwise(1.0)
    return found.join(asked.select("qid", "terms"), "qid", "left").select("qid", "node", (F.col("score") * factor).alias("score"))
