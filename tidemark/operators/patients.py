"""Current state as of a date, and interval joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covering(intervals: DataFrame, started: str, ended: str, day: Column) -> DataFrame:
    """Intervals [start, end) that hold a day; a null end is open."""
    begin, end = F.col(started).cast("date"), F.col(ended).cast("date")
    return intervals.where((begin <= day) & (end.isNull() | (end > day)))


def patients_as_of(patients: DataFrame, transitions: DataFrame, as_of: date) -> DataFrame:
    """One row per patient born by as_of, with the payer then in force and a death only once it happened.

    The date is a constant, so the interval side is filtered before the join and shuffles little.
    """
    day = F.lit(as_of)
    payer = covering(transitions, "START_DATE", "END_DATE", day).select(F.col("PATIENT").alias("_patient"), F.col("PAYER").alias("payer_id"))
    dead = F.col("DEATHDATE").isNotNull() & (F.col("DEATHDATE") <= day)
    born = patients.where(F.col("BIRTHDATE") <= day)
    return born.join(payer, born["Id"] == payer["_patient"], "left").select(
        F.col("Id").alias("patient_id"),
        F.col("BIRTHDATE").alias("birthdate"),
        F.col("GENDER").alias("gender"),
        F.col("RACE").alias("race"),
        F.col("ETHNICITY").alias("ethnicity"),
        F.col("BIRTHPLACE").alias("birthplace"),
        "payer_id",
        F.coalesce(dead, F.lit(False)).alias("is_deceased"),
        F.when(dead, F.col("DEATHDATE")).alias("deceased_date"),
        day.alias("_as_of_date"),
    )


def version_at(facts: DataFrame, versions: DataFrame, key: str, day: str, how: str = "left") -> DataFrame:
    """Point-in-time read: each fact with the version of its key that was valid on its day."""
    v = versions.withColumnRenamed(key, "_vkey")
    holds = (facts[key] == v["_vkey"]) & (v["valid_from"] <= facts[day]) & (v["valid_to"].isNull() | (v["valid_to"] > facts[day]))
    return facts.join(v, holds, how).drop("_vkey")
