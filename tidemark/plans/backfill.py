"""A backfill by months: one run at a time, in order, each landing and build retried, sources fresh before a build."""

from __future__ import annotations

import argparse
import time
from collections.abc import Iterator
from datetime import date, datetime, timezone

from pyspark.sql import SparkSession

from tidemark.operators.history import BackwardsAsOf
from tidemark.plans import warehouse
from tidemark.sources.landing import LoadReport, land_window
from tidemark.sources.store import Store


def months(start: date, end: date) -> Iterator[tuple[date, date]]:
    """Half-open windows that tile [start, end), cut at the first of each month."""
    while start < end:
        after = date(start.year + start.month // 12, start.month % 12 + 1, 1)
        yield start, min(after, end)
        start = after


def retried(fn, retries: int, delay: float):
    """fn(), tried again after a pause; a refusal to go backwards is final."""
    for left in range(retries, -1, -1):
        try:
            return fn()
        except BackwardsAsOf:
            raise
        except Exception:
            if not left:
                raise
            time.sleep(delay)


def backfill(spark: SparkSession, store: Store, source: str, start: date, end: date, retries: int = 2, delay: float = 60.0) -> list[LoadReport]:
    """Land and build month by month. A month that fails for good ends the run; those before it stay."""
    reports = []
    with store.lock():
        for first, last in months(start, end):
            reports.append(retried(lambda a=first, b=last: land_window(spark, store, source, a, b), retries, delay))
            retried(lambda: warehouse.build(store, fresh_at=datetime.now(timezone.utc)), retries, delay)
    return reports


def main(argv: list[str] | None = None) -> int:
    """python -m tidemark.plans.backfill --source DIR --store DIR --start D --end D [--retries N]."""
    from tidemark.session import get_session

    parser = argparse.ArgumentParser(description=main.__doc__)
    for name in ("--source", "--store"):
        parser.add_argument(name, required=True)
    for name in ("--start", "--end"):
        parser.add_argument(name, type=date.fromisoformat, required=True)
    parser.add_argument("--retries", type=int, default=2)
    args = parser.parse_args(argv)
    spark = get_session("backfill")
    for report in backfill(spark, Store(spark, args.store), args.source, args.start, args.end, args.retries):
        print(report)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
