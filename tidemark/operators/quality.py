"""Assertions as DataFrames of violations: a check passes when it returns no row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Assertion:
    """A named check. severity warn reports without failing; where narrows the rows checked."""

    name: str
    violations: Callable[[], DataFrame]
    severity: str = "error"


def unique(df: DataFrame, *cols: str, where: Column | None = None) -> DataFrame:
    """Keys held by more than one row; rows with a null in the key are not compared."""
    rows = (df if where is None else df.where(where)).dropna(subset=list(cols))
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_null(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """Rows without a value."""
    return (df if where is None else df.where(where)).where(F.col(col).isNull())


def relationships(child: DataFrame, col: str, parent: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """Children whose non-null key has no parent."""
    rows = (child if where is None else child.where(where)).where(F.col(col).isNotNull())
    return rows.join(parent.select(F.col(key).alias("_parent")), F.col(col) == F.col("_parent"), "left_anti")


def accepted_values(df: DataFrame, col: str, values: list) -> DataFrame:
    """Rows outside a closed list; null is accepted."""
    return df.where(~F.col(col).isin(values))


def accepted_range(df: DataFrame, col: str, low=None, high=None) -> DataFrame:
    """Rows outside an inclusive range; null is accepted."""
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(col) < low)
    if high is not None:
        outside = outside | (F.col(col) > high)
    return df.where(outside)


def version_gaps(versions: DataFrame, key: str) -> DataFrame:
    """Versions that do not end where the next of their key begins."""
    w = Window.partitionBy(key).orderBy("valid_from")
    return versions.withColumn("next_from", F.lead("valid_from").over(w)).where(~F.col("valid_to").eqNullSafe(F.col("next_from")))


def idle_versions(versions: DataFrame, key: str, checked: list[str]) -> DataFrame:
    """Versions that say the same as the one before them."""
    w = Window.partitionBy(key).orderBy("valid_from")
    state = F.struct(*[F.col(c) for c in checked])
    return versions.withColumns({"_prev": F.lag(state).over(w), "_has": F.lag("valid_from").over(w).isNotNull()}).where(F.col("_has") & state.eqNullSafe(F.col("_prev"))).drop("_prev", "_has")


def child_totals_differ(fact: DataFrame, **children: DataFrame) -> DataFrame:
    """One row per kind of child whose total in the fact is not the rows it has."""
    parts = []
    for name, rows in children.items():
        have = fact.agg(F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias("counted"))
        parts.append(have.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("held")))).select(F.lit(name).alias("child"), "counted", "held"))
    return reduce(DataFrame.unionByName, parts).where("counted <> held")


def unabsorbed_restatements(fact: DataFrame, log: DataFrame) -> DataFrame:
    """Restated claims whose latest logged amount is not the one the fact shows."""
    newest = log.groupBy("claim_id").agg(F.max(F.struct("received_date", "is_restatement", "amount_after")).alias("last")).where("last.is_restatement")
    joined = fact.join(newest, "claim_id", "inner")
    return joined.where(F.abs(F.col("billed_amount") - F.col("last.amount_after")) >= 0.005).drop("last")


def contract_breaches(df: DataFrame, expected: T.StructType) -> list[str]:
    """Differences between a frame's columns and types and its contract; checked before a write."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in expected}
    out = [f"missing {c}" for c in want if c not in have] + [f"unexpected {c}" for c in have if c not in want]
    if not out and list(have) != list(want):
        out.append(f"order is {', '.join(have)}")
    return out + [f"{c} is {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and have[c] != want[c]]


def freshness(df: DataFrame, loaded: str, now: Column, warn_hours: int = 24, error_hours: int = 48) -> DataFrame:
    """One row: the newest load, its age in hours at a fixed moment, and pass, warn or error."""
    newest = df.agg(F.max(loaded).alias("newest"))
    age = F.timestamp_diff("SECOND", F.col("newest"), now) / F.lit(3600.0)
    status = F.when(age.isNull() | (age > error_hours), "error").when(age > warn_hours, "warn").otherwise("pass")
    return newest.select("newest", age.alias("age_hours"), status.alias("status"))


def column_summary(df: DataFrame, name: str, wrong: dict[str, Column]) -> DataFrame:
    """Violations of several conditions on one frame's rows, in one pass: what is wrong, by the check's name."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{k}") for k, c in enumerate(wrong.values())])
    rows = F.array(*[F.struct(F.lit(f"{name}: {check}").alias("assertion"), F.lit("error").alias("severity"), F.col(f"c{k}").alias("violations")) for k, check in enumerate(wrong)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def summary(checks: list[Assertion]) -> DataFrame:
    """Violations per assertion, all in one query."""
    rows = [c.violations().agg(F.count(F.lit(1)).alias("violations")).select(F.lit(c.name).alias("assertion"), F.lit(c.severity).alias("severity"), "violations") for c in checks]
    return reduce(DataFrame.unionByName, rows)
