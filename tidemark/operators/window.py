"""Half-open date windows and the rows that belong to them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DateWindow:
    """[start, end)."""

    start: date
    end: date

    def __post_init__(self) -> None:
        if self.end <= self.start:
            raise ValueError(f"window end {self.end} is not after its start {self.start}")

    def holds(self, day: Column) -> Column:
        """True for a day inside; reaches the Parquet scan as a range filter."""
        return (day >= F.lit(self.start)) & (day < F.lit(self.end))

    def outside(self, day: Column) -> Column:
        """The complement, with null days outside."""
        return day.isNull() | (day < F.lit(self.start)) | (day >= F.lit(self.end))


def window_keys(parents: DataFrame, key: str, started: str, window: DateWindow) -> DataFrame:
    """The parents of a window: their key and service date, nothing wider."""
    day = F.col(started).cast("date")
    return parents.where(window.holds(day)).select(F.col(key).alias("_key"), day.alias("_service_date"))


def inherit_window(rows: DataFrame, keys: DataFrame, foreign_key: str) -> DataFrame:
    """Rows whose parent lies in the window, dated by the parent's clock and not by their own."""
    return rows.join(keys, rows[foreign_key] == keys["_key"], "inner").drop("_key")


def replace_window(held: DataFrame, arriving: DataFrame, day: str, window: DateWindow) -> DataFrame:
    """Copy-on-write delete-and-insert of one window."""
    return held.where(window.outside(F.col(day))).unionByName(arriving)
