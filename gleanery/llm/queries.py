"""One query for each operator, over its whole table with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, centroids, language, media, mixing, negatives, packing, placement, quality, simhash, substrings, syncmers, urls
from gleanery.session import prepare, spread

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Fixed values of the URL query's contract: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table documents for operators that spend their time on each text."""
    return spread(table(spark, sf_dir, "documents"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language.held_out(F.col("doc_id"), 4, 2)
    found = language.identify(docs, language.learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(documents(spark, sf_dir))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(documents(spark, sf_dir))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM later, range(0, 20) AS r(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_audio(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP6_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
rules(verdict, r_host, r_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT p.page_id, p.host, p.path, r_host || r_path AS rule, verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC) AS n
  FROM parts p LEFT JOIN rules r
    ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return placement.place(docs.select("doc_id", "source"), SHARDS).select("doc_id", "source", "slot", "shard")


def op8_sql() -> str:
    owners = ",".join(map(str, placement.lookup_table(SHARDS)))
    return f"""
WITH t AS (SELECT string_split('{owners}', ',') AS owners),
s AS (SELECT doc_id, source,
             CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {placement.DIGITS})) AS BIGINT) % {placement.SLOTS} AS slot
      FROM documents)
SELECT doc_id, source, slot, CAST(owners[slot + 1] AS BIGINT) AS shard FROM s, t
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), TOKENIZER)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language.held_out(F.col("doc_id"), 5, 0)
    model = quality.learn(docs.select("doc_id", "text").where(~held), table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_report(spread(table(spark, sf_dir, "embeddings")))


def op11_sql() -> str:
    """The rounds written out one after another; inner products of small integers are exact in doubles."""
    rounds = []
    for i in range(centroids.ROUNDS + 1):
        rounds.append(f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, v, n AS cluster, d FROM (
    SELECT vec_id, v, n, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, n) AS r FROM (
      SELECT vec_id, v, n, CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) AS d
      FROM k, c{i})) WHERE r = 1)""")
        if i < centroids.ROUNDS:
            rounds.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT n, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % q) + q) % q) // q AS DOUBLE) ORDER BY p) AS m FROM (
      SELECT cluster, p, sum(CAST(x AS BIGINT)) AS s, count(*) AS q
      FROM (SELECT cluster, unnest(v) AS x, unnest(range({centroids.DIMS})) AS p FROM a{i}) GROUP BY cluster, p) GROUP BY cluster)
  ON n = cluster)""")
    last = centroids.ROUNDS
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.DIMS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS n, v AS c
  FROM (SELECT v, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM k ORDER BY h LIMIT {centroids.CENTROIDS})),{",".join(rounds)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON cluster = n
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    rows = spread(table(spark, sf_dir, "embeddings")).withColumn("label", F.when(turned, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, F.col("key") % 100 == 0)


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM s WHERE same) WHERE n <= 5),
w AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digests(documents(spark, sf_dir), TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_fingerprints, op2_language, op3_simhash, op4_substrings, op5_media, op6_url_filters, op7_mixing, op8_sharding, op9_bpe, op10_quality, op11_centroids, op12_negatives, op13_packing]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_substrings": OP4_SQL, "op6_url_filters": OP6_SQL, "op8_sharding": op8_sql(), "op11_centroids": op11_sql(), "op12_negatives": OP12_SQL}
