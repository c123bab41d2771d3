"""Type-2 history over a source that only shows its current state."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class BackwardsAsOf(ValueError):
    """The arriving state is older than the newest version held."""


def refuse_backwards(history: DataFrame | None, as_of: date) -> None:
    """Raise before anything is written if as_of precedes the newest version; equal dates pass."""
    newest = history.agg(F.max("valid_from").alias("d")).first()["d"] if history is not None else None
    if newest is not None and datetime.combine(as_of, datetime.min.time()) < newest:
        raise BackwardsAsOf(f"as-of date {as_of} is before {newest.date()}, the newest version held")


def fold_snapshot(history: DataFrame | None, state: DataFrame, key: str, checked: list[str], as_of: date) -> DataFrame:
    """History after seeing a state: changed keys close and reopen, new keys open, absent keys stay.

    Comparison is null-safe over the checked columns only. history holds state's columns plus
    valid_from and valid_to (timestamp_ntz).
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    opened = state.withColumns({"valid_from": at, "valid_to": F.lit(None).cast("timestamp_ntz")})
    if history is None:
        return opened
    # one full join, so that a chain of folds reads each history once
    own = state.columns
    h, s = history.alias("h"), state.alias("s")
    met = h.join(s, (F.col(f"h.{key}") == F.col(f"s.{key}")) & F.col("h.valid_to").isNull(), "full")
    mine, theirs = F.struct(*[F.col(f"h.{c}") for c in checked]), F.struct(*[F.col(f"s.{c}") for c in checked])

    def version(side: str, start: Column, end: Column) -> Column:
        return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in own], start.alias("valid_from"), end.alias("valid_to"))

    kept = version("h", F.col("h.valid_from"), F.col("h.valid_to"))
    closed = version("h", F.col("h.valid_from"), at)
    new = version("s", at, F.lit(None).cast("timestamp_ntz"))
    absent, unseen = F.col("h.valid_from").isNull(), F.col(f"s.{key}").isNull()
    rows = F.when(absent, F.array(new)).when(unseen | mine.eqNullSafe(theirs), F.array(kept)).otherwise(F.array(closed, new))
    return met.select(F.explode(rows).alias("v")).select("v.*")


def versions_of(states: DataFrame, key: str, checked: list[str], at: str) -> DataFrame:
    """Closed form of the fold: states seen at ascending dates become versions where something changed."""
    seen = Window.partitionBy(key).orderBy(at)
    now = F.struct(*[F.col(c) for c in checked])
    first = F.row_number().over(seen) == 1
    changed = states.withColumns({"_first": first, "_same": now.eqNullSafe(F.lag(now).over(seen))}).where(F.col("_first") | ~F.col("_same"))
    return changed.drop("_first", "_same").withColumnRenamed(at, "valid_from").withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from")))


def is_current() -> Column:
    """Open versions are the current ones."""
    return F.col("valid_to").isNull().alias("is_current")
