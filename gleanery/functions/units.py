"""Texts cut into addressable units with offsets, titles and term statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T

HEADING_CUT = r"(?md)^(?=#{1,4} )"


def before_each(numbers: Column) -> Column:
    """For each of an array of numbers the sum of those before it; higher-order functions would copy the sums at each step."""

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: np.cumsum(x) - x)

    return run(numbers)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, off, text, title, line of every part that a heading of level 1 to 4 begins, and of a preamble; blank parts go."""
    rows = docs.select(key, F.split(T.text_of(text), HEADING_CUT).alias("_parts"))
    rows = rows.withColumn("_off", before_each(F.transform("_parts", lambda p: F.length(p))))
    rows = rows.withColumn("_line", before_each(F.transform("_parts", lambda p: F.regexp_count(p, F.lit("\n")))))
    rows = rows.select(key, F.explode(F.arrays_zip("_off", "_parts", "_line")).alias("p")).select(
        key, F.col("p._off").alias("off"), F.col("p._parts").alias("text"), (F.col("p._line") + 1).cast("long").alias("line"))
    rows = rows.where(F.length(F.trim(F.regexp_replace("text", r"\s", " "))) > 0)
    first = F.regexp_extract("text", r"(?d)^([^\n]*)", 1)
    title = F.when(first.rlike(r"^#{1,4} "), F.trim(F.regexp_replace(first, r"^#+", ""))).otherwise("")
    return rows.select(key, "off", "text", title.alias("title"), "line")


def line_at(text: Column, offset: Column) -> Column:
    """The line (from 1) in which a character offset (from 0) stands."""
    return (F.lit(1) + F.regexp_count(F.substring(text, F.lit(1), offset.cast("int")), F.lit("\n"))).cast("long")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), text and off of every line."""
    rows = docs.select(key, F.posexplode(F.split(T.text_of(text), "\n")).alias("n", "text"))
    run = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, (F.col("n") + 1).cast("long").alias("line"), "text", F.coalesce(F.sum(F.length("text") + 1).over(run), F.lit(0)).cast("long").alias("off"))


def counted(units: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """keys, dl (every emitted token counts) and terms, an array of term and tf. A unit's tokens are sorted and counted in place, so nothing is shuffled."""
    rows = units.select(*keys, F.sort_array(tokens).alias("_sorted"))
    rows = rows.withColumn("_starts", F.when(F.size("_sorted") > 0, F.filter(
        F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1)))))
    found = F.transform("_starts", lambda i, n: F.struct(
        F.get("_sorted", i).alias("term"), (F.coalesce(F.get("_starts", n + 1), F.size("_sorted")) - i).cast("long").alias("tf")))
    return rows.select(*keys, F.size("_sorted").cast("long").alias("dl"), found.alias("terms"))


def exploded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dl, term, tf of counted units."""
    return rows.select(*keys, "dl", F.explode("terms").alias("t")).select(*keys, "dl", "t.term", "t.tf")


def terms(units: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """keys, dl, term, tf."""
    return exploded(counted(units, keys, tokens), keys)


def embedding_text(stem: Column, title: Column, text: Column) -> Column:
    """What an embedder gets for a section: its place, then its first 6000 characters."""
    head = F.when(F.length(title) > 0, F.concat(stem, F.lit(" › "), title)).otherwise(stem)
    return F.concat(head, F.lit("\n"), F.substring(text, 1, 6000))
