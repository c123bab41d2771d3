"""Grain-safe facts: children are aggregated before they meet their parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import days_between
from tidemark.operators.upsert import latest_per_key


def child_counts(children: DataFrame, parent: str, name: str) -> DataFrame:
    """Rows per parent, with a map-side partial count."""
    return children.groupBy(parent).agg(F.count(F.lit(1)).alias(name))


def with_child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with a zero-filled count per kind of child; never multiplies a parent."""
    out = parents
    for name, rows in children.items():
        out = out.join(child_counts(rows, key, name), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))
    return out


def encounter_fact(encounters: DataFrame, conditions: DataFrame, medications: DataFrame) -> DataFrame:
    """One row per encounter: ids, times, costs, what the patient owes, and two counts."""
    counted = with_child_counts(encounters, "encounter_id", condition_count=conditions, medication_count=medications)
    return counted.withColumn("patient_responsibility", F.col("total_claim_cost") - F.col("payer_coverage"))


def claim_fact(arrivals: DataFrame) -> DataFrame:
    """The latest arrival of each claim with its billing lag."""
    newest = latest_per_key(arrivals, ["claim_id"], [F.col("received_date").desc()])
    return newest.withColumn("billing_lag_days", days_between(F.col("service_date"), F.col("received_date")))
