"""The 30-day readmission measure and the reconciliations that guard it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import days_between


def stays(encounters: DataFrame, stay_class: str = "inpatient") -> DataFrame:
    """Admission and discharge dates of the encounters of one class."""
    return encounters.where(F.col("encounter_class") == stay_class).select(
        "encounter_id", "patient_id", F.col("started_at").cast("date").alias("admit_date"), F.col("stopped_at").cast("date").alias("discharge_date")
    )


def observed_to(encounters: DataFrame) -> DataFrame:
    """One row: the last service date over all classes."""
    return encounters.agg(F.max("_service_date").alias("observed_to"))


def index_admissions(encounters: DataFrame, horizon: int = 30, stay_class: str = "inpatient") -> DataFrame:
    """Stays that were observed for the whole horizon after discharge."""
    end = F.broadcast(observed_to(encounters))  # one row
    return stays(encounters, stay_class).crossJoin(end).where(days_between(F.col("discharge_date"), F.col("observed_to")) >= horizon).drop("observed_to")


def readmissions(encounters: DataFrame, horizon: int = 30, stay_class: str = "inpatient") -> DataFrame:
    """Every index admission with the earliest stay that begins 1..horizon days after its discharge.

    A patient's stays meet once, in one shuffle: a range frame over the admission dates, in days,
    finds the earliest stay in the gap, so no self-join multiplies them. Gap 0 or less is a transfer.
    """
    day = F.unix_date(F.col("admit_date")).cast("bigint")
    out = F.unix_date(F.col("discharge_date")).cast("bigint")
    every = stays(encounters, stay_class).withColumns({"_in": day, "_out": out})
    # each stay appears as a candidate at its admission day and as a probe at its discharge day
    kinds = F.explode(F.array(F.struct(F.col("_in").alias("_at"), F.lit(0).alias("_probe")), F.struct(F.col("_out").alias("_at"), F.lit(1).alias("_probe"))))
    line = every.withColumn("_k", kinds).select("*", "_k._at", "_k._probe").drop("_k")
    candidate = F.when(F.col("_probe") == 0, F.struct(F.col("_in"), F.col("encounter_id").alias("_id")))
    ahead = Window.partitionBy("patient_id").orderBy("_at").rangeBetween(1, horizon)
    found = line.withColumn("_next", F.min(candidate).over(ahead)).where(F.col("_probe") == 1)
    end = F.broadcast(observed_to(encounters))
    gap = F.col("_next._in") - F.col("_out")
    return (
        found.crossJoin(end)
        .where(days_between(F.col("discharge_date"), F.col("observed_to")) >= horizon)
        .select(
            F.col("encounter_id").alias("index_encounter_id"), "patient_id", "admit_date", "discharge_date",
            F.col("_next._id").alias("readmission_encounter_id"), gap.alias("days_to_readmission"), F.col("_next._id").isNotNull().alias("is_readmitted"),
        )
    )


def readmission_rate(measure: DataFrame, *by: str) -> DataFrame:
    """Readmissions over index admissions per group."""
    return measure.groupBy(*by).agg(
        F.count(F.lit(1)).alias("index_admissions"), F.sum(F.col("is_readmitted").cast("bigint")).alias("readmissions")
    ).withColumn("rate", F.col("readmissions").cast("double") / F.col("index_admissions"))


def denominator_gaps(encounters: DataFrame, measure: DataFrame, horizon: int = 30, stay_class: str = "inpatient") -> DataFrame:
    """Index admissions missing from the measure, and measure rows nobody expected."""
    want = index_admissions(encounters, horizon, stay_class).select(F.col("encounter_id").alias("expected_id"))
    have = measure.select(F.col("index_encounter_id").alias("measured_id"))
    return want.join(have, want["expected_id"] == have["measured_id"], "full").where(F.col("expected_id").isNull() | F.col("measured_id").isNull())


def minimum_gaps(encounters: DataFrame, measure: DataFrame, horizon: int = 30, stay_class: str = "inpatient") -> DataFrame:
    """Per index admission the gap recomputed by a left range join and a minimum, beside the measured one."""
    later = stays(encounters, stay_class).select(F.col("patient_id").alias("_p"), F.col("admit_date").alias("_a"))
    gap = days_between(F.col("discharge_date"), F.col("_a"))
    joined = measure.join(later, (measure["patient_id"] == later["_p"]) & gap.between(1, horizon), "left")
    return joined.groupBy("index_encounter_id", "days_to_readmission").agg(F.min(gap).alias("recomputed_gap"))
