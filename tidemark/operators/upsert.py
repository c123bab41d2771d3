"""Latest-arrival upserts: late rows are always admitted per key, never by a global watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; Catalyst turns this into a group-limited window."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == 1).drop("_rank")


def admit_newer(batch: DataFrame, held: DataFrame, keys: list[str], received: str) -> DataFrame:
    """Rows of a batch whose key is new, or which arrived strictly later than what is held."""
    seen = held.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col(received).alias("_h_received"), F.lit(True).alias("_h"))
    same = [batch[k] == seen[f"_h_{k}"] for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    later = (batch[received] > F.col("_h_received")) | (F.col("_h_received").isNull() & batch[received].isNotNull())
    admitted = F.col("_h").isNull() | later
    return batch.join(seen, cond, "left").where(admitted).select(*[batch[c] for c in batch.columns])


def merge_latest(held: DataFrame, batch: DataFrame, keys: list[str], received: str, ties: list[Column] = ()) -> DataFrame:
    """One incremental build: per key the latest arrival, where a held row gives way to a strictly later one only.

    The same rows as admitting by admit_newer, collapsing and replacing by key, in one pass over each side.
    """
    both = held.withColumn("_held", F.lit(1)).unionByName(batch.withColumn("_held", F.lit(0)))
    order = [F.col(received).desc_nulls_last(), F.desc("_held"), *ties]
    return latest_per_key(both, keys, order).drop("_held")
