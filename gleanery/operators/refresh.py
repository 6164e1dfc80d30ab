"""Incremental refresh: what changed between the stamps of an index and the live files, and only that recomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many pending files are refreshed before a search; with more, the old index serves.
STALE_BUDGET = 50


def changes(live: DataFrame, stamps: DataFrame, key: str = "path", stamp: str = "mtime") -> DataFrame:
    """key, change: new, changed, gone or same."""
    old = stamps.select(F.col(key).alias("_k"), F.col(stamp).alias("_old"))
    rows = live.select(key, stamp).join(old, F.col(key) == F.col("_k"), "full_outer")
    change = F.when(F.col("_k").isNull(), "new").when(F.col(key).isNull(), "gone").when(F.col(stamp).eqNullSafe(F.col("_old")), "same").otherwise("changed")
    return rows.select(F.coalesce(key, "_k").alias(key), change.alias("change"))


def state(changed: DataFrame, built: bool = True) -> DataFrame:
    """One row: state (cold, stale, ready) and pending."""
    pending = F.count_if(F.col("change") != "same")
    counted = changed.agg(pending.alias("pending"))
    name = F.when(F.lit(not built), "cold").when(F.col("pending") > 0, "stale").otherwise("ready")
    return counted.select(name.alias("state"), "pending")


def merge(old: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """old rows of unchanged keys and fresh rows of new and changed ones; gone keys leave."""
    kept = old.join(changed.where("change = 'same'").select(key), key, "left_semi")
    return kept.unionByName(fresh.join(changed.where("change IN ('new', 'changed')").select(key), key, "left_semi"))


def should_refresh(current: str, pending: int, budget: int = STALE_BUDGET) -> bool:
    return current == "cold" or (current == "stale" and pending <= budget)


def vectors_current(meta: dict, model: str, prefix: str, dim: int) -> bool:
    """Whether stored vectors are of the model, document prefix and size in use."""
    return (meta.get("model"), meta.get("doc_prefix"), meta.get("dim"), meta.get("unit")) == (model, prefix, dim, "section")


def dense_state(enabled: bool, consented: bool, failed: bool, warming: bool, vectors: int) -> str:
    if not enabled:
        return "off"
    if not consented:
        return "consent_required"
    if failed:
        return "failed"
    if warming:
        return "warming"
    return "ready" if vectors else "no_vectors"
