"""Mixing sources to target weights, in DataFrame functions only.

The words of each source stand in one stream (documents in order of a hash bucket, then of their key), cut into blocks
of a fixed length. A source has as many slots as its target asks for. Output shards of SHARD_SLOTS slots each (the last
has the rest) draw from the deck of all slots: place i of the mix takes the card that a keyed permutation of the deck
puts there, and the cards of a shard's places say how many slots each source gives it. These counts are multinomial with
the sources' totals given, as drawing the totals too would leave small sources far from their targets. A source's slots
are numbered along its counts, shard by shard. They go through its blocks in turns; in each turn a keyed permutation of
the block numbers ("swap or not", a bijection on any range) says which block a slot takes. Slots and documents meet in a
join by source and block number, and every word taken belongs to the shard that drew its slot.

Sources stand in order of code point, null last, and weigh 1, 2, 3, 1, 2, 3 and so on unless weights are given. A
source's target stops at LIMIT times its size; the excess goes to the others by weight until none is above. A source
takes at most LIMIT turns, so no document gives more than LIMIT times its words. Null and empty texts have size 0 and
give nothing; repeated rows each count; an empty table gives an empty result. Any number of sources will do: their table
is joined like any other, and only sums over it reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.columns import WORD, count_words
from gleanery.session import materialise

BLOCK_WORDS = 128
LIMIT = 3
WEIGHTS = (1, 2, 3)
ROUNDS = 24
#: Slots made by one task; slots of an output shard, more if there would be over MAX_SHARDS of them.
CHUNK_SLOTS, SHARD_SLOTS, MAX_SHARDS = 50_000, 65_536, 1_000_000
#: Sources summed at once, least number of cells of the deck, sources whose places in it are handed to every executor.
GROUP_SOURCES, CELLS, MAX_BROADCAST = 4_096, 4_096, 100_000


def literal(values: Sequence, kind: str) -> Column:
    """An array of the driver's values."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def permuted(at: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The image of at in a pseudorandom permutation of 0 to n-1 that belongs to key."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), at, swap)


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes (source, size) with sid, the sources' places in order of code point, null last."""
    placed = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed, "mix-sources")
    part = F.shiftright("at", 33).cast("int")
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each task
    before = [0]
    for k in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(k, 0))
    return placed.select("source", "size", (F.get(literal(before, "bigint"), part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("sid"))


def planned(sized: DataFrame, weights: Sequence[float] | None, block_words: int, limit: int) -> DataFrame:
    """A row for each source of sized: sid, source, source_size, target, blocks, slots.

    An open source's target is its weight times a rate common to all; those that reach the limit close and the rate
    rises, until no more close.
    """
    weight = F.coalesce(F.get(literal(weights or WEIGHTS, "double"), (F.col("sid") if weights else F.col("sid") % len(WEIGHTS)).cast("int")), F.lit(0.0))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("size"))
    rows = numbered(sizes).withColumn("weight", weight)
    most = F.lit(limit) * F.col("size")
    rate, closed = 0.0, -1
    while True:
        over = most < F.lit(rate) * F.col("weight")
        total, held, free, n = rows.agg(
            F.sum("size"), F.sum(F.when(over, most).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("long"))).first()
        if n == closed or not free:
            break
        rate, closed = (total - held) / free, n
    target = F.least(most.cast("double"), F.lit(rate) * F.col("weight"))
    blocks = F.ceil(F.col("size") / block_words)
    slots = F.when(F.col("size") > 0, F.least(F.round(target * blocks / F.col("size")).cast("long"), limit * blocks)).otherwise(0)
    found = rows.select("sid", "source", F.col("size").alias("source_size"), target.alias("target"), blocks.cast("long").alias("blocks"), slots.cast("long").alias("slots"))
    return materialise(found, "mix-plan")


def deck(plan: DataFrame) -> DataFrame:
    """sid, first and slots of the sources that have any: where each one's cards begin in the deck, in order of sid."""
    group = F.floor(F.col("sid") / GROUP_SOURCES)
    rows = plan.where("slots > 0").select("sid", "slots", group.alias("group"))
    running = lambda w: F.coalesce(F.sum("slots").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = rows.groupBy("group").agg(F.sum("slots").alias("slots"))
    groups = groups.select("group", running(Window.orderBy("group")).alias("before"))  # a row for each GROUP_SOURCES sources
    rows = rows.withColumn("inner", running(Window.partitionBy("group").orderBy("sid"))).join(groups, "group")
    return rows.select("sid", (F.col("before") + F.col("inner")).alias("first"), "slots")


def counts(plan: DataFrame) -> DataFrame:
    """shard, sid and n: how many slots every output shard draws from each source, where it draws any."""
    total, sources = plan.where("slots > 0").agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    size = max(SHARD_SLOTS, -(-total // MAX_SHARDS))
    cell = -(-max(total, 1) // max(CELLS, sources))  # cards meet their source in cells of the deck
    low, high = F.floor(F.col("first") / cell), F.floor((F.col("first") + F.col("slots") - 1) / cell)
    owners = deck(plan).select("sid", "first", (F.col("first") + F.col("slots")).alias("end"), F.explode(F.sequence(low, high)).alias("cell"))
    owners = F.broadcast(owners) if sources <= MAX_BROADCAST else owners  # two rows a source at most, and CELLS
    places = plan.sparkSession.range(0, total, 1, min(max(1, -(-total // CHUNK_SLOTS)), 10_000))
    places = places.withColumn("card", permuted(F.col("id"), F.lit(max(total, 1)), F.lit("deck")))
    places = places.select(F.floor(F.col("id") / size).alias("shard"), "card", F.floor(F.col("card") / cell).alias("cell"))
    drawn = places.join(owners, (places["cell"] == owners["cell"]) & (F.col("card") >= F.col("first")) & (F.col("card") < F.col("end")))
    return materialise(drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n")), "mix-counts")


def slots(plan: DataFrame) -> DataFrame:
    """Every slot of the mix: sid, turn, block (its number) and the shard that drew it."""
    drawn = counts(plan)
    chunks = drawn.agg(F.sum(F.ceil(F.col("n") / CHUNK_SLOTS))).first()[0]
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    first = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    spread = drawn.withColumn("first", first).join(plan.select("sid", "blocks"), "sid").repartition(min(max(1, chunks or 0), 10_000), "sid", "shard")
    spread = spread.select("sid", "shard", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64("sid", turn))
    return spread.select("sid", turn.alias("turn"), block.alias("block"), "shard")


def offsets(sized: DataFrame, plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sized with sid and start: where in its source's stream a row's words begin.

    Two levels of running sums, each over about the square root of the rows: over the buckets of a source, then inside
    one bucket, so that no task holds a source.
    """
    known = plan.select("sid", F.col("source").alias("_name"), "source_size", "target")
    rows = sized.join(known, sized["source"].eqNullSafe(known["_name"])).drop("_name")
    buckets = max(1, isqrt(sized.count()))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("mix"), *keys), F.lit(buckets)))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("sid", "bucket").orderBy(*keys, "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, ["sid", "bucket"])
    return rows.withColumn("start", F.col("bucket_start") + F.col("inner_start")).drop("bucket", "bucket_start", "inner_start")


def spans(rows: DataFrame, block_words: int) -> DataFrame:
    """For each row with words and each block it reaches into: the words of it that lie there."""
    last = F.col("start") + F.col("size") - 1
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor(last / block_words))))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(last, F.col("block") * block_words + (block_words - 1))
    return cut.withColumns({"from_word": low - F.col("start"), "n_words": high - low + 1})


def taken(rows: DataFrame, plan: DataFrame, block_words: int) -> DataFrame:
    """The spans of rows with used, the (shard, turn) of each time that the mix takes them."""
    # Slots come from a table of few rows, so the optimizer takes them for few: it must not broadcast them.
    used = slots(plan).groupBy("sid", "block").agg(F.collect_list(F.struct("shard", "turn")).alias("used")).hint("merge")  # LIMIT at most
    return spans(rows, block_words).join(used, ["sid", "block"], "left")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] | None = None, block_words: int = BLOCK_WORDS, limit: int = LIMIT,
) -> DataFrame:
    """key, size, source_size, target, taken, and shards (the sorted numbers of the output shards with words of it) of every row."""
    sized = docs.select(docs[key].alias("key"), docs[source].alias("source"), count_words(docs[text]).alias("size"))
    sized = materialise(sized, "mix-sizes")
    plan = planned(sized, weights, block_words, limit)
    rows = offsets(sized, plan, ["key"])
    columns = ["key", "size", "source_size", "target"]
    total = F.sum(F.col("n_words") * F.coalesce(F.size("used"), F.lit(0))).cast("long").alias("taken")
    shards = F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("used")), lambda u: u["shard"]))).alias("shards")
    found = taken(rows, plan, block_words).withColumn("used", F.coalesce("used", F.array().cast("array<struct<shard:bigint,turn:bigint>>")))
    found = found.groupBy(*columns, "sid", "start").agg(total, shards).select(*columns, "taken", "shards")
    empty = rows.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("shards"))
    return found.unionByName(empty).withColumnRenamed("key", key)


def mix_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] | None = None, block_words: int = BLOCK_WORDS, limit: int = LIMIT, shard: str | None = None,
) -> DataFrame:
    """The mix as rows of docs: a row for each document, output shard and turn, with the words that this shard takes then.

    The words of a row's blocks stand in order, each with the white space before it; a document of which nothing is
    taken goes. Further columns stay as they are; if a name is given for it, the shard's number is one more.
    """
    others = [c for c in docs.columns if c not in (key, text, source) and "map<" not in docs.schema[c].dataType.simpleString()]
    same = F.xxhash64(docs[key].isNull(), docs[key], docs[source].isNull(), docs[source], docs[text])
    turn = F.row_number().over(Window.partitionBy("_mix_same").orderBy(*([F.xxhash64(*(F.col(c) for c in others))] if others else ["_mix_same"])))
    rows = docs.withColumn("_mix_same", same).withColumn("_mix_n", turn)  # repeated rows each count
    sized = rows.select(F.col(key).alias("key"), F.col("_mix_same").alias("same"), F.col("_mix_n").alias("n"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"))
    sized = materialise(sized, "mix-sizes")
    plan = planned(sized, weights, block_words, limit)
    used = taken(offsets(sized, plan, ["key", "same", "n"]), plan, block_words).where("used IS NOT NULL")
    used = used.select("same", "n", "from_word", "n_words", F.explode("used").alias("u"))
    parts = used.groupBy("same", "n", "u.shard", "u.turn").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("parts"))
    parts = parts.groupBy(F.col("same").alias("_mix_same"), F.col("n").alias("_mix_n")).agg(
        F.sort_array(F.collect_list(F.struct("shard", "turn", "parts"))).alias("_mix_used"))
    rows = rows.join(parts, ["_mix_same", "_mix_n"])
    # Exploded as the only element of an array, so that the words are cut once a document and not once a lookup.
    rows = rows.withColumn("_mix_words", F.explode(F.array(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)))))

    def piece(p: Column) -> Column:
        return F.array_join(F.slice(F.col("_mix_words"), (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")), "")

    pieces = F.transform("_mix_used", lambda u: F.struct(u["shard"].alias("shard"), F.array_join(F.transform(u["parts"], piece), "").alias("text")))
    rows = rows.withColumn("_mix_piece", F.explode(pieces)).withColumn(text, F.col("_mix_piece.text"))
    return rows.select(*docs.columns, *([F.col("_mix_piece.shard").alias(shard)] if shard else []))
