"""The densest windows of a text for a query's terms, in column expressions.

A text is cut once into pieces of a quarter of a window; a window is some neighbouring pieces, so no position costs a
walk from the start of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

Terms = list[tuple[str, float]]


def density(part: Column, terms: Terms | Column) -> Column:
    """Summed weights of all occurrences of the terms in a part: a list, or an array of struct(term, weight)."""
    if isinstance(terms, Column):
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + T.occurrences(part, t["term"]) * t["weight"])
    return sum((T.occurrences(part, F.lit(t)) * F.lit(float(w)) for t, w in terms), F.lit(0.0))


def with_densities(rows: DataFrame, text: str, terms: Terms | Column, width: int, out: str) -> DataFrame:
    """rows with an array of struct(hits, back) of all windows: back is the start offset with its sign turned.

    A text without any of the terms has just its first window.
    """
    step = max(1, width // 4)
    pieces, low = f"_{out}_pieces", f"_{out}_low"
    rows = rows.withColumn(low, F.lower(T.text_of(text)))
    holds = F.exists(terms, lambda t: F.contains(F.col(low), t["term"])) if isinstance(terms, Column) else reduce(
        Column.__or__, (F.contains(F.col(low), F.lit(t)) for t, _ in terms), F.lit(False))
    rows = rows.withColumn(pieces, F.when(holds, F.regexp_extract_all(low, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))))
    count = F.floor((F.greatest(F.lit(1), F.length(text) - width) + (step - 1)) / step).cast("int") + 1
    at = lambda i: F.coalesce(F.get(F.col(pieces), i), F.lit(""))
    full, rest = divmod(width, step)
    window = lambda i: F.concat(*(at(i + k) for k in range(full)), *([F.substring(at(i + full), 1, rest)] if rest else []))
    tried = F.transform(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1), lambda i: F.struct(density(window(i), terms).alias("hits"), (-i * step).alias("back")))
    first = F.array(F.struct(F.lit(0.0).alias("hits"), F.lit(0).alias("back")))
    return rows.withColumn(out, F.when(F.col(pieces).isNotNull(), tried).otherwise(first)).drop(pieces, low)


def with_densest(rows: DataFrame, text: str, terms: Terms | Column, width: int, off: str = "off", hits: str = "hits") -> DataFrame:
    """rows with the offset and density of the earliest window of the highest density.

    Both are 0 for a text no longer than a window, for a null text, and where there is no term.
    """
    best = f"_{off}_best"
    rows = with_densities(rows, text, terms, width, best)
    none = (F.size(terms) == 0) if isinstance(terms, Column) else F.lit(not terms)
    whole = F.coalesce(F.length(text), F.lit(0)) <= width
    rows = rows.withColumn(best, F.when(~(whole | none), F.array_max(best)))
    return rows.withColumns({off: F.coalesce(-F.col(best)["back"], F.lit(0)).cast("int"), hits: F.coalesce(F.col(best)["hits"], F.lit(0.0))}).drop(best)


def snapped(text: Column, off: Column, width: int) -> Column:
    """off moved to the start of its line, if that is less than a step back."""
    step = max(1, width // 4)
    low = F.greatest(F.lit(0), off - step)
    before = F.substring(text, low + 1, off - low)
    back = F.locate("\n", F.reverse(before))
    return F.when(back > 0, off - back + 1).otherwise(off).cast("int")


def with_windows(rows: DataFrame, text: str, terms: Terms | Column, width: int, n: int, out: str = "windows") -> DataFrame:
    """rows with the offsets of up to n disjoint windows, each the densest of those left, in order of the text.

    The first is taken whatever its density, later ones only with an occurrence.
    """
    rows = with_densities(rows, text, terms, width, f"_{out}")
    start = F.struct(F.col(f"_{out}").alias("left"), F.array().cast("array<int>").alias("taken"))

    def pick(acc: Column, i: Column) -> Column:
        best = F.array_max(acc["left"])
        ok = best.isNotNull() & ((F.size(acc["taken"]) == 0) | (best["hits"] > 0))
        rest = F.filter(acc["left"], lambda c: F.abs(c["back"] - best["back"]) >= width)
        return F.when(ok, F.struct(rest.alias("left"), F.concat(acc["taken"], F.array(-best["back"])).alias("taken"))).otherwise(acc)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, pick, lambda acc: F.array_sort(acc["taken"]))
    none = (F.size(terms) == 0) if isinstance(terms, Column) else F.lit(not terms)
    head = (F.coalesce(F.length(text), F.lit(0)) <= n * width) | none
    return rows.withColumn(out, F.when(head, F.array(F.lit(0))).otherwise(found)).drop(f"_{out}")
