"""Pure functions on one text as Arrow functions over a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the named string column holds about limit bytes in each; a longer text stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(lengths.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def scalar(function: Callable, kind: str):
    """An iterator pandas function of one string column; null goes in as None."""

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([function(None if x is None or x is pd.NA else x) for x in part.tolist()], dtype=object if kind in ("string", "boolean") else None)

    return run


def generate(rows: DataFrame, keys: list[str], texts: list[str], function: Callable, fields: list[tuple[str, str]]) -> DataFrame:
    """keys and fields: one row for each tuple that function(*texts) yields."""
    source = rows.select(*keys, *texts)
    n = len(keys)
    schema = ", ".join([*(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys), *(f"`{f}` {t}" for f, t in fields)])
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    names = [*keys, *(f for f, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, n):
            at, values = [], []
            for i, parts in enumerate(zip(*(batch.column(n + k).to_pylist() for k in range(len(texts))), strict=True)):
                for row in function(*parts):
                    at.append(i)
                    values.append(row)
            columns = list(zip(*values, strict=True)) if values else [()] * len(fields)
            picked = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*picked, *(pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True))], names)

    return source.mapInArrow(run, schema)
