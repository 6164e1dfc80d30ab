"""Embedders as Arrow functions: a hashing one that needs no model, one over an HTTP endpoint, and a register of others."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import units

BATCH = 16
DIMENSIONS = 256
LEAST_TOKENS = 3
EMBEDDERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def normal(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=v.copy(), where=size > 0)


def hashed(texts: list[str], size: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of words and of their neighbours, hashed into a vector of unit length."""
    out = np.zeros((len(texts), size))
    for i, text in enumerate(texts):
        words = text.lower().split()
        for w in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            h = xxhash.xxh64_intdigest(w)
            out[i, h % size] += 1 if h >> 63 else -1
    return normal(out)


EMBEDDERS["hashed"] = hashed


def endpoint(url: str, model: str) -> Callable[[list[str]], np.ndarray]:
    """An embedder behind an endpoint that takes {model, input} and answers {data: [{index, embedding}]}."""

    def run(texts: list[str]) -> np.ndarray:
        rows: list[list[float]] = []
        for at in range(0, len(texts), BATCH):
            body = json.dumps({"model": model, "input": texts[at : at + BATCH]}).encode()
            request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=120) as reply:
                rows += [d["embedding"] for d in sorted(json.load(reply)["data"], key=lambda d: d["index"])]
        return normal(np.array(rows))

    return run


def embed_sections(sections: DataFrame, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """path, off, mtime, v of sections (path, off, mtime, title, text, dl) of LEAST_TOKENS tokens or more."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]+$", "")
    rows = sections.where(F.col("dl") >= LEAST_TOKENS).select("path", "off", "mtime", units.embedding_text(stem, F.col("title"), F.col("text")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = [list(map(float, x)) for x in embed(batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(v, pa.list_(pa.float32()))], ["path", "off", "mtime", "v"])

    return rows.mapInArrow(run, "path string, off int, mtime double, v array<float>")


def carry_over(stored: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored vectors that still hold, and the sections that have none."""
    live = sections.select("path", "mtime").distinct()
    kept = stored.join(live, ["path", "mtime"], "left_semi")
    return kept, sections.join(kept.select("path", "mtime").distinct(), ["path", "mtime"], "left_anti")
