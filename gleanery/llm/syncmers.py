"""Document fingerprints from closed syncmers, in DataFrame functions only.

A run of up to LONGEST characters that aren't white space is one token. In a longer one, as in scripts without blanks,
so is each such run of letters a-z or of digits, and each other character; so a token depends on its neighbours alone
and not on where its run begins. Of the windows of K tokens, those are anchors whose least inner pair of tokens (by hash) stands at an edge; whether a
window is one depends on its own tokens alone, so a passage has the same anchors wherever it stands. The fingerprint is
the SKETCH smallest distinct anchor hashes, in order, eight hex digits each; equal texts have equal fingerprints.

A text of fewer than K tokens has one anchor, its whole token sequence; an empty text or null has none and the empty
fingerprint. Two empty fingerprints have likeness 1, an empty one and another 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

K = 5
INNER = 2
LONGEST = 16
SKETCH = 64
MASK = 0xFFFFFFFF
#: Border points that the driver reads, and rows meant for one bucket between them.
COARSE, BUCKET_ROWS = 512, 2_000
#: Numbers of buckets that one task puts in order.
GROUP = 4_096
#: Heads of buckets are handed to every executor up to this number.
MAX_HEADS = 500_000


def alone(kind: str) -> str:
    """A pattern of up to LONGEST characters of a kind between others."""
    return rf"(?<!{kind}){kind}{{1,{LONGEST}}}+(?!{kind})"


VISIBLE = r"[^\x20\x09-\x0D]"
TOKEN = "|".join([*map(alone, (VISIBLE, "[A-Za-z]", "[0-9]")), VISIBLE])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def with_anchors(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with an array of the anchor hashes of a text column, in order of position, repeats included.

    Each step is a column of its own that the next one uses more than once, so that none is computed twice.
    """
    words, hashes, pairs = f"_{out}_words", f"_{out}_hashes", f"_{out}_pairs"
    rows = rows.withColumn(words, tokens(F.coalesce(rows[text], F.lit(""))))
    rows = rows.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size(hashes)
    rows = rows.withColumn(pairs, F.zip_with(
        F.slice(hashes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(hashes, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.xxhash64(a, b)))
    m = F.greatest(F.size(pairs) - (K - INNER), F.lit(0))
    edges = F.zip_with(F.slice(pairs, F.lit(1), m), F.slice(pairs, F.lit(4), m), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inside = F.zip_with(F.slice(pairs, F.lit(2), m), F.slice(pairs, F.lit(3), m), lambda a, b: F.least(a, b))
    chosen = F.zip_with(edges, inside, lambda e, i: F.when(
        (e["a"] <= i) | (e["b"] <= i), F.xxhash64(e["a"], e["b"], i).bitwiseAND(F.lit(MASK))))
    whole = F.array(F.xxhash64(F.array_join(words, " ")).bitwiseAND(F.lit(MASK)))
    anchors = F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).when(F.size(hashes) < K, whole).otherwise(chosen)
    return rows.withColumn(out, anchors).drop(words, hashes, pairs)


def anchor_positions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each anchor: key, position (of its first token, from 0) and anchor hash, for positional matching."""
    rows = with_anchors(docs.select(docs[key], docs[text]), text, "_anchors")
    return rows.select(key, F.posexplode("_anchors").alias("position", "anchor")).where("anchor IS NOT NULL")


def sketch_of(anchors: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.array_compact(anchors))), 1, SKETCH)


def with_sketch(rows: DataFrame, text: str, out: str) -> DataFrame:
    anchors = f"_{out}_anchors"
    return with_anchors(rows, text, anchors).withColumn(out, sketch_of(F.col(anchors))).drop(anchors)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common anchors among all anchors of two texts, from their sketches: 0 to 1."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both)).cast("double")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars and fingerprint of every row."""
    rows = docs.select(docs[key], F.coalesce(docs[text], F.lit("")).alias("_text"))
    rows = with_sketch(rows, "_text", "_sketch")
    return rows.select(key, F.length("_text").cast("long").alias("n_chars"), as_text(F.col("_sketch")).alias("fingerprint"))


def bucket_of(docs: DataFrame, key: str) -> Column:
    """A number that falls or stays as the key falls, the same for equal keys; null keys come last.

    The driver reads COARSE quantiles of the key; between two of them the width is divided evenly.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must be a whole number: it orders the documents")
    points = F.percentile_approx(key, [i / COARSE for i in range(1, COARSE)], 10_000)
    n, low, high, cuts = docs.agg(F.count(key), F.min(key), F.max(key), points).first()
    if not n:
        return F.lit(-1).cast("long")
    wanted = max(1, n // BUCKET_ROWS)
    every = max(1, -(-(COARSE - 1) // wanted))
    edges = sorted({low, *(cuts or [])[every - 1 :: every]})
    fine = max(1, round(wanted / len(edges)))
    borders = F.array(*(F.lit(e).cast("long") for e in edges))
    at = F.size(F.filter(borders, lambda b: b <= F.col(key)))
    left = F.get(borders, at - 1)
    right = F.coalesce(F.get(borders, at), F.lit(high + 1).cast("long"))
    if fine == 1:
        return F.coalesce(at.cast("long"), F.lit(-1).cast("long"))
    inner = F.least(F.floor((F.col(key) - left).cast("double") / (right - left) * fine), F.lit(fine - 1)).cast("long")
    return F.coalesce(at * F.lit(fine).cast("long") + inner, F.lit(-1).cast("long"))


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (null: empty), sketch, and the next document's text and sketch in descending order of key, after the last the first.

    Keys are whole numbers. Rows of one key follow each other in order of text; null keys come last. The rows are dealt into ordered buckets, and
    the first row of each bucket stands a second time, as a border row, at the end of the bucket before.
    """
    rows = docs.select(docs[key], F.coalesce(docs[text], F.lit("")).alias("text"))
    keys = rows.select(key)
    bucket = bucket_of(keys, key)
    heads = keys.select(key, bucket.alias("bucket")).groupBy("bucket").agg(F.max(key).alias("head")).withColumn("group", F.floor(F.col("bucket") / GROUP))
    # The bucket before in descending order: of the same group of numbers, else the least of the group before.
    groups = heads.groupBy("group").agg(F.min("bucket").alias("low"))
    over = Window.orderBy(F.desc("group"))
    every = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select("group", F.coalesce(F.lag("low").over(over), F.last("low").over(every)).alias("before"))
    inside = Window.partitionBy("group").orderBy(F.desc("bucket"))
    heads = heads.withColumn("same", F.lag("bucket").over(inside)).join(groups, "group").select("head", F.coalesce("same", "before").alias("bucket"))
    small = heads.count() <= MAX_HEADS
    borders = rows.join(F.broadcast(heads) if small else heads, rows[key].eqNullSafe(heads["head"]))
    both = rows.select(key, "text", bucket.alias("bucket"), F.lit(0).alias("border")).unionByName(
        borders.select(key, "text", "bucket", F.lit(1).alias("border")))
    both = with_sketch(both, "text", "sketch")
    following = Window.partitionBy("bucket").orderBy("border", F.col(key).desc_nulls_last(), "text")
    both = both.withColumns({"next_text": F.lead("text").over(following), "next_sketch": F.lead("sketch").over(following)})
    return both.where("border = 0").drop("bucket", "border")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of an edited text, whose last third is the start of the next document."""
    rows = beside_next(docs, key, text)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        key, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
