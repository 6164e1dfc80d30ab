"""Points in spans by equi-joins: spans cut into bins of a power of two, innermost spans by a window.

A span whose length lies between two powers of two touches two bins of the larger one at most. It is written out for
these, a point for its bin at each power that some span has (63 at most), and both meet on key, power and bin; no point
meets a span that ends over two lengths away. Spans include both ends; those that end before they begin hold nothing.
Null keys and ends meet nothing. Repeated points and spans each count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def power(length: Column) -> Column:
    """The least p with 2**p >= length, for lengths from 1."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def containing(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """The columns of points and of spans (but for keys) for every point in a span of its key; names are distinct but for keys."""
    held = spans.where(F.col(end) >= F.col(start)).withColumn("_power", power(F.col(end) - F.col(start) + 1))
    powers = sorted(r[0] for r in held.select("_power").distinct().collect())  # 64 at most
    size = F.expr("shiftleft(1L, _power)")
    bin_of = lambda x: F.floor(F.col(x) / size)  # noqa: E731  ends stay below 2**53
    held = held.withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    asked = points.where(F.col(at).isNotNull()).withColumn("_power", F.explode(F.array(*map(F.lit, powers)) if powers else F.array().cast("array<int>"))).withColumn("_bin", bin_of(at))
    found = asked.join(held, [*keys, "_power", "_bin"]).where(F.col(at).between(F.col(start), F.col(end)))
    return found.drop("_power", "_bin")


def innermost(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str = "at", start: str = "start", end: str = "end", ties: Sequence[str] = ()) -> DataFrame:
    """The shortest span around each point (keys and at), of equals the one that begins last, then the first by ties; points outside all spans give no row."""
    found = containing(points.select(*keys, at).distinct(), spans, keys, at, start, end)
    order = Window.partitionBy(*keys, at).orderBy(F.col(end) - F.col(start), F.desc(start), *ties)
    return found.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
