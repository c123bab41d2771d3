"""Landing one half-open window of the export: idempotent, order-independent, one commit, and only the months it touches."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.claims import Restatement, billed_in, claim_arrivals, injection_log
from tidemark.operators.patients import patients_as_of
from tidemark.operators.window import DateWindow, inherit_window, window_keys
from tidemark.sources.store import Change, Store

#: Parent key by windowed table; dimensions are replaced whole.
WINDOWED = {"encounters": "Id", "conditions": "ENCOUNTER", "medications": "ENCOUNTER"}
DIMENSIONS = ("providers", "payers")
#: The date that places a row of each table in a window.
DAYS = {f"raw.{name}": "_service_date" for name in WINDOWED} | {"raw.claims": "received_date", "meta.injection_log": "received_date"}


@dataclass(frozen=True)
class LoadReport:
    """What a landing left behind: its window, and by table the rows that lie in it."""

    start: date
    end: date
    rows: dict[str, int] = field(default_factory=dict)


def _months(store: Store, name: str, window: DateWindow) -> frozenset[str]:
    """The held months that a window reaches into."""
    first, last = f"{window.start:%Y-%m}", f"{window.end - timedelta(days=1):%Y-%m}"
    return frozenset(m for m in store.parts(name) if first <= m <= last)


def _swap(store: Store, name: str, arriving: DataFrame, window: DateWindow) -> Change:
    """The window's rows replaced, in the months it touches: what those hold outside the window stays."""
    day, touched = DAYS[name], _months(store, name, window)
    kept = store.read(name, set(touched)).where(window.outside(F.col(day))) if touched else None
    rows = arriving if kept is None else kept.unionByName(arriving)
    return Change(rows, F.date_format(day, "yyyy-MM"), touched)


def _arrivals(spark: SparkSession, source: str, window: DateWindow, rule: Restatement, keys: DataFrame | None = None, claims: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a window brings, by table. keys and claims: the window's parents and claim arrivals, if they are staged."""
    read = lambda name: spark.read.parquet(f"{source}/{name}.parquet")
    keys = window_keys(read("encounters"), "Id", "START", window) if keys is None else keys
    out = {f"raw.{name}": inherit_window(read(name), keys, key) for name, key in WINDOWED.items()}
    if claims is None:
        claims = claim_arrivals(billed_in(read("claims"), window, rule), read("encounters"), rule).where(window.holds(F.col("received_date")))
    out["raw.claims"] = claims.drop("lag_days", "is_restatement", "amount_before")
    out["meta.injection_log"] = injection_log(claims)
    out |= {f"raw.{name}": read(name) for name in DIMENSIONS}
    out["raw.patients_current"] = patients_as_of(read("patients"), read("payer_transitions"), window.end)
    loaded = F.lit(datetime.now(timezone.utc)).cast("timestamp")  # one literal per landing
    return {name: df.withColumn("_loaded_at", loaded) for name, df in out.items()}


def create_tables(spark: SparkSession, store: Store, source: str) -> list[str]:
    """Commit an empty typed table for each that is absent; returns their names."""
    window = DateWindow(date(1900, 1, 1), date(1900, 1, 2))
    missing = {name: df.limit(0) for name, df in _arrivals(spark, source, window, Restatement()).items() if not store.exists(name)}
    if missing:
        store.commit({name: Change(df, F.date_format(DAYS[name], "yyyy-MM")) if name in DAYS else df for name, df in missing.items()})
    return list(missing)


def land_window(spark: SparkSession, store: Store, source: str, start: date, end: date, rule: Restatement = Restatement()) -> LoadReport:
    """Replace one window in the raw layer.

    Children belong to the window of their parent's service date; claims to that of the date they were
    received; patients are shown as of the window's end. The window's parents and its claim arrivals are
    computed once. Every table is written before one commit.
    """
    window = DateWindow(start, end)
    read = lambda name: spark.read.parquet(f"{source}/{name}.parquet")
    keys = window_keys(read("encounters"), "Id", "START", window)
    inside = claim_arrivals(billed_in(read("claims"), window, rule), read("encounters"), rule).where(window.holds(F.col("received_date")))
    with store.staged(keys=keys, claims=inside) as (keys, claims):
        arriving = _arrivals(spark, source, window, rule, keys, claims)
        store.commit({name: _swap(store, name, df, window) if name in DAYS else df for name, df in arriving.items()})
    held = store.manifest()
    rows = {}
    for name in (n for n in arriving if n.startswith("raw.")):
        if name in DAYS:
            rows[name[4:]] = store.read(name, set(_months(store, name, window))).where(window.holds(F.col(DAYS[name]))).count()
        else:
            rows[name[4:]] = sum(p["rows"] for p in held[name]["parts"].values())
    return LoadReport(start, end, rows)


def main(argv: list[str] | None = None) -> int:
    """python -m tidemark.sources.landing --window-start D --window-end D --source DIR --store DIR."""
    from tidemark.session import get_session

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--window-start", type=date.fromisoformat, required=True)
    parser.add_argument("--window-end", type=date.fromisoformat, required=True)
    parser.add_argument("--source", required=True)
    parser.add_argument("--store", required=True)
    args = parser.parse_args(argv)
    spark = get_session("landing")
    print(land_window(spark, Store(spark, args.store), args.source, args.window_start, args.window_end))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
