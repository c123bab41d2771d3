"""Claim arrivals: exact apportionment of a parent's cost, and deterministic restatements."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import days_between, hash_pick, round2
from tidemark.operators.window import DateWindow


@dataclass(frozen=True)
class Restatement:
    """How many keys are restated, and how late at most. Fixed values of the data contract."""

    seed: int = 20251231
    percent: int = 5
    max_lag_days: int = 30


def apportion(children: DataFrame, parent: str, order: list[str], amounts: dict[str, str]) -> DataFrame:
    """Split each parent's amounts over its children so that they sum exactly.

    amounts maps an input column (the parent's amount, repeated on every child) to the output
    column. All children but the last in the total order take the rounded share; the last takes the
    remainder. Must run over every child of a parent: filter windows afterwards.
    """
    every, ranked = Window.partitionBy(parent), Window.partitionBy(parent).orderBy(*order)
    placed = children.withColumns({"_n": F.count(F.lit(1)).over(every), "_seq": F.row_number().over(ranked)})

    def share(total: Column) -> Column:
        even = round2(total / F.col("_n"))
        return F.when(F.col("_seq") < F.col("_n"), even).otherwise(total - even * (F.col("_n") - 1))

    return placed.withColumns({out: share(F.col(src)) for src, out in amounts.items()}).drop("_n", "_seq")


def restatement_draws(key: Column, rule: Restatement) -> dict[str, Column]:
    """is_restated, restate_lag and factor of a key. The factor straddles 1.0 and never equals it."""
    draw = hash_pick(key, "factor", rule.seed, 50)
    below = F.lit(0.75) + draw.cast("double") / F.lit(100.0)
    above = F.lit(1.01) + (draw - 25).cast("double") / F.lit(100.0)
    return {
        "is_restated": hash_pick(key, "restated", rule.seed, 100) < rule.percent,
        "restate_lag": hash_pick(key, "restatelag", rule.seed, rule.max_lag_days) + 1,
        "factor": F.when(draw < 25, below).otherwise(above),
    }


def with_restatements(originals: DataFrame, key: str, rule: Restatement) -> DataFrame:
    """Originals plus the later, changed arrival of the restated keys, in one pass over the input.

    Needs service_date, received_date, billed_amount and payer_coverage; adds lag_days,
    is_restatement and amount_before (null on originals).
    """
    drawn = originals.withColumns(restatement_draws(F.col(key), rule))
    kinds = F.when(F.col("is_restated"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = drawn.withColumn("is_restatement", F.explode(kinds))
    late = F.col("is_restatement")
    received = F.when(late, F.date_add("received_date", F.col("restate_lag"))).otherwise(F.col("received_date"))
    scaled = {c: F.when(late, round2(F.col(c) * F.col("factor"))).otherwise(F.col(c)) for c in ("billed_amount", "payer_coverage")}
    before = F.when(late, F.col("billed_amount"))
    return (
        rows.withColumns({"amount_before": before, "received_date": received, **scaled})
        .withColumn("lag_days", days_between(F.col("service_date"), F.col("received_date")).cast("int"))
        .drop("is_restated", "restate_lag", "factor")
    )


def billed_in(claims: DataFrame, window: DateWindow, rule: Restatement) -> DataFrame:
    """All claims of every encounter of which a claim, or its restatement, may arrive in the window."""
    day = F.col("LASTBILLEDDATE1").cast("date")
    near = claims.where((day >= F.lit(window.start - timedelta(days=rule.max_lag_days))) & (day < F.lit(window.end)))
    return claims.join(near.select("APPOINTMENTID").distinct(), "APPOINTMENTID", "left_semi")


def claim_arrivals(claims: DataFrame, encounters: DataFrame, rule: Restatement = Restatement()) -> DataFrame:
    """Every arrival of the claims given; all claims of an encounter must be, or none."""
    costs = encounters.select(F.col("Id").alias("encounter_id"), F.col("TOTAL_CLAIM_COST").alias("_cost"), F.col("PAYER_COVERAGE").alias("_cover"))
    billed = claims.select(
        F.col("Id").alias("claim_id"),
        F.col("APPOINTMENTID").alias("encounter_id"),
        F.col("PATIENTID").alias("patient_id"),
        F.col("HEALTHCARECLAIMTYPEID1").cast("int").alias("claim_type_id"),
        F.col("SERVICEDATE").cast("date").alias("service_date"),
        F.col("LASTBILLEDDATE1").cast("date").alias("received_date"),
    ).join(costs, "encounter_id", "inner")
    priced = apportion(billed, "encounter_id", ["claim_id"], {"_cost": "billed_amount", "_cover": "payer_coverage"})
    return with_restatements(priced.drop("_cost", "_cover"), "claim_id", rule)


def restatement_pairs(log: DataFrame) -> DataFrame:
    """Of each restated claim the days between its two arrivals, both amounts, and whether the log agrees on the first."""
    first, last = log.where(~F.col("is_restatement")).alias("o"), log.where("is_restatement").alias("r")
    later = days_between(F.col("o.received_date"), F.col("r.received_date"))
    return first.join(last, F.col("o.claim_id") == F.col("r.claim_id")).select(
        "o.claim_id", later.alias("days_later"), F.col("o.amount_after").alias("amount_first"), F.col("r.amount_after").alias("amount_last"),
        (F.col("r.amount_before") == F.col("o.amount_after")).alias("agrees"),
    )


def injection_log(arrivals: DataFrame) -> DataFrame:
    """The answer key: what was injected into each arrival."""
    return arrivals.select(
        "claim_id", "encounter_id", "service_date", "received_date", "lag_days", "is_restatement", "amount_before",
        F.col("billed_amount").alias("amount_after"),
    )
