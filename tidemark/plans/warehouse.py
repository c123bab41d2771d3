"""The star schema as a graph, and its build over a store."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import days_between
from tidemark.operators import facts, history, quality, readmission, upsert
from tidemark.plans.graph import Graph
from tidemark.sources.merge import merge_into
from tidemark.sources.store import Store

GRAPH = Graph()

#: Output names by source column; fixed values of the data contract.
ENCOUNTER_COLUMNS = {
    "Id": "encounter_id", "PATIENT": "patient_id", "ORGANIZATION": "organization_id", "PROVIDER": "provider_id", "PAYER": "payer_id",
    "ENCOUNTERCLASS": "encounter_class", "CODE": "encounter_code", "DESCRIPTION": "encounter_description", "REASONCODE": "reason_code",
    "REASONDESCRIPTION": "reason_description", "START": "started_at", "STOP": "stopped_at", "BASE_ENCOUNTER_COST": "base_encounter_cost",
    "TOTAL_CLAIM_COST": "total_claim_cost", "PAYER_COVERAGE": "payer_coverage", "_service_date": "_service_date", "_loaded_at": "_loaded_at",
}
CONDITION_COLUMNS = {
    "ENCOUNTER": "encounter_id", "PATIENT": "patient_id", "CODE": "condition_code", "SYSTEM": "code_system", "DESCRIPTION": "condition_description",
    "START": "started_on", "STOP": "stopped_on", "_service_date": "_service_date", "_loaded_at": "_loaded_at",
}
MEDICATION_COLUMNS = {
    "ENCOUNTER": "encounter_id", "PATIENT": "patient_id", "PAYER": "payer_id", "CODE": "medication_code", "DESCRIPTION": "medication_description",
    "REASONCODE": "reason_code", "REASONDESCRIPTION": "reason_description", "START": "started_at", "STOP": "stopped_at", "DISPENSES": "dispenses",
    "BASE_COST": "base_cost", "TOTALCOST": "total_cost", "PAYER_COVERAGE": "payer_coverage", "_service_date": "_service_date", "_loaded_at": "_loaded_at",
}
PROVIDER_COLUMNS = {"Id": "provider_id", "ORGANIZATION": "organization_id", "NAME": "provider_name", "GENDER": "gender", "SPECIALITY": "speciality", "CITY": "city", "STATE": "state", "ZIP": "zip", "_loaded_at": "_loaded_at"}
PAYER_COLUMNS = {"Id": "payer_id", "NAME": "payer_name", "OWNERSHIP": "ownership", "_loaded_at": "_loaded_at"}
CODES = {"encounter_code", "reason_code", "condition_code", "medication_code"}
CHECKED = ["birthdate", "gender", "race", "ethnicity", "birthplace", "payer_id", "is_deceased", "deceased_date"]


def rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Project and rename; clinical codes become text."""
    return df.select(*[(F.col(src).cast("string") if out in CODES else F.col(src)).alias(out) for src, out in columns.items()])


for _name, _columns in (("encounters", ENCOUNTER_COLUMNS), ("conditions", CONDITION_COLUMNS), ("medications", MEDICATION_COLUMNS), ("providers", PROVIDER_COLUMNS), ("payers", PAYER_COLUMNS)):
    GRAPH.model(f"stg_{_name}", f"raw.{_name}", kind="view")(lambda df, _c=_columns: rename(df, _c))
GRAPH.model("stg_claims", "raw.claims", kind="view")(lambda df: df)
GRAPH.model("stg_patients_current", "raw.patients_current", kind="view")(lambda df: df)
GRAPH.model("dim_payer", "stg_payers")(lambda df: df.select("payer_id", "payer_name", "ownership"))
GRAPH.model("dim_provider", "stg_providers")(lambda df: df.drop("speciality", "_loaded_at"))


@GRAPH.model("fct_encounter", "stg_encounters", "stg_conditions", "stg_medications")
def fct_encounter(encounters: DataFrame, conditions: DataFrame, medications: DataFrame) -> DataFrame:
    """Encounters at their own grain."""
    return facts.encounter_fact(encounters.drop("_loaded_at"), conditions, medications)


@GRAPH.model("fct_readmission", "fct_encounter")
def fct_readmission(encounters: DataFrame) -> DataFrame:
    """Index admissions with their earliest readmission."""
    return readmission.readmissions(encounters)


@GRAPH.model("fct_claim", "stg_claims", kind="incremental", merge=("claim_id", "received_date"))
def fct_claim(arrivals: DataFrame) -> DataFrame:
    """One row per claim: the latest arrival. Merged, only new or strictly later arrivals change what is held."""
    batch = arrivals.withColumn("billing_lag_days", days_between(F.col("service_date"), F.col("received_date")))
    return upsert.latest_per_key(batch, ["claim_id"], [F.col("received_date").desc()])


@GRAPH.model("snap_patient", "stg_patients_current", kind="snapshot")
def snap_patient(state: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Patient history folded by one state; refuses a state older than what it holds."""
    first = state.select("_as_of_date").first()
    if first is None:
        if held is None:
            raise ValueError("no patient state to snapshot")
        return held
    history.refuse_backwards(held, first[0])
    return history.fold_snapshot(held, state.drop("_as_of_date", "_loaded_at"), "patient_id", CHECKED, first[0])


@GRAPH.model("dim_patient", "snap_patient")
def dim_patient(versions: DataFrame) -> DataFrame:
    """Versions with their validity and a flag."""
    return versions.select("patient_id", "payer_id", *CHECKED[:5], "is_deceased", "deceased_date", "valid_from", "valid_to", history.is_current())


READMISSION_CONTRACT = T.StructType([
    T.StructField("index_encounter_id", T.StringType()), T.StructField("patient_id", T.StringType()), T.StructField("admit_date", T.DateType()),
    T.StructField("discharge_date", T.DateType()), T.StructField("readmission_encounter_id", T.StringType()), T.StructField("days_to_readmission", T.LongType()),
    T.StructField("is_readmitted", T.BooleanType()),
])
PATIENT_CONTRACT = T.StructType([
    T.StructField("patient_id", T.StringType()), T.StructField("payer_id", T.StringType()), T.StructField("birthdate", T.DateType()),
    *[T.StructField(c, T.StringType()) for c in CHECKED[1:5]], T.StructField("is_deceased", T.BooleanType()), T.StructField("deceased_date", T.DateType()),
    T.StructField("valid_from", T.TimestampNTZType()), T.StructField("valid_to", T.TimestampNTZType()), T.StructField("is_current", T.BooleanType()),
])
CONTRACTS = {"fct_readmission": READMISSION_CONTRACT, "dim_patient": PATIENT_CONTRACT}


class ContractError(ValueError):
    """A model's columns or types are not those promised."""


def relation(store: Store, name: str) -> DataFrame:
    """A source, a view over it, or a built model."""
    node = GRAPH.nodes.get(name)
    if node is not None and node.kind == "view":
        return node.fn(*[relation(store, i) for i in node.inputs])
    return store.read(name if node is None else f"mart.{name}")


class StaleSource(RuntimeError):
    """A source was last loaded too long ago."""


def freshness(store: Store, now: datetime, warn_hours: int = 24, error_hours: int = 48) -> DataFrame:
    """Per loaded source its newest load, age and status."""
    moment = F.lit(now).cast("timestamp")
    found = [quality.freshness(store.read(name), "_loaded_at", moment, warn_hours, error_hours).withColumn("source", F.lit(name)) for name in SOURCES if store.exists(name)]
    if not found:
        raise StaleSource("no source was ever loaded")
    return reduce(DataFrame.unionByName, found)


def require_fresh(store: Store, now: datetime, **hours: int) -> list[str]:
    """Raise if a source is stale; returns the sources that are getting old."""
    rows = freshness(store, now, **hours).collect()  # one row a source
    if stale := [r["source"] for r in rows if r["status"] == "error"]:
        raise StaleSource(f"stale: {', '.join(sorted(stale))}")
    return sorted(r["source"] for r in rows if r["status"] == "warn")


def build(store: Store, select: list[str] | None = None, exclude: list[str] = (), full_refresh: bool = False, fresh_at: datetime | None = None) -> dict[str, int]:
    """Build the chosen models in order; each table is committed before its dependants read it.

    full_refresh rebuilds an incremental from its input and starts a snapshot anew, discarding history.
    fresh_at: a moment at which sources must be fresh, or nothing is built.
    """
    if fresh_at is not None:
        require_fresh(store, fresh_at)
    made: dict[str, DataFrame] = {}
    rows: dict[str, int] = {}

    def resolve(name: str) -> DataFrame:
        return made[name] if name in made else relation(store, name)

    for name in GRAPH.select(select, exclude):
        node = GRAPH.nodes[name]
        inputs = [resolve(i) for i in node.inputs]
        if node.kind == "view":
            made[name] = node.fn(*inputs)
            continue
        keeps = node.kind == "snapshot" and not full_refresh
        out = node.fn(*inputs, held=store.get(f"mart.{name}")) if keeps else node.fn(*inputs)
        if name in CONTRACTS and (wrong := quality.contract_breaches(out, CONTRACTS[name])):
            raise ContractError(f"{name}: {'; '.join(wrong)}")
        if node.merge and not full_refresh:
            rows[f"mart.{name}"] = merge_into(store, f"mart.{name}", out, [node.merge[0]], node.merge[1])
        else:
            rows |= store.commit({f"mart.{name}": out})
        made[name] = store.read(f"mart.{name}")
    return rows


#: Declared tests by model; fixed values of the data contract.
SOURCES = ["raw.encounters", "raw.conditions", "raw.medications", "raw.claims", "raw.providers", "raw.payers", "raw.patients_current"]
NOT_NULL = {
    "stg_encounters": "encounter_id patient_id encounter_code total_claim_cost _service_date",
    "stg_conditions": "encounter_id condition_code",
    "stg_medications": "encounter_id medication_code",
    "stg_claims": "claim_id encounter_id received_date billed_amount",
    "stg_providers": "provider_id",
    "stg_payers": "payer_id payer_name",
    "stg_patients_current": "patient_id birthdate _as_of_date",
    "snap_patient": "patient_id valid_from",
    "dim_provider": "provider_id",
    "dim_payer": "payer_id payer_name",
    "dim_patient": "patient_id birthdate valid_from",
    "fct_encounter": "encounter_id patient_id provider_id payer_id total_claim_cost patient_responsibility condition_count medication_count _service_date",
    "fct_claim": "claim_id encounter_id patient_id received_date billed_amount billing_lag_days",
    "fct_readmission": "index_encounter_id patient_id discharge_date is_readmitted",
}
UNIQUE = [
    ("stg_encounters", "encounter_id"), ("stg_providers", "provider_id"), ("stg_payers", "payer_id"), ("stg_patients_current", "patient_id"), ("dim_provider", "provider_id"),
    ("dim_payer", "payer_id"), ("fct_encounter", "encounter_id"), ("fct_claim", "claim_id"), ("fct_readmission", "index_encounter_id"),
]
RELATIONS = [
    ("stg_conditions", "encounter_id", "stg_encounters", "error"), ("stg_medications", "encounter_id", "stg_encounters", "error"), ("stg_claims", "encounter_id", "stg_encounters", "warn"),
    ("dim_patient", "payer_id", "dim_payer", "error"), ("fct_encounter", "provider_id", "dim_provider", "error"), ("fct_encounter", "payer_id", "dim_payer", "error"),
]
ACCEPTED = {"stg_encounters": {"encounter_class": "ambulatory wellness outpatient urgentcare emergency inpatient home virtual snf hospice".split()}}
RANGES = {"fct_readmission": {"days_to_readmission": (1, 30)}}


def assertions(store: Store) -> list[quality.Assertion]:
    """The data tests of the built warehouse."""
    r = lambda n: store.read(f"mart.{n}")
    raw = lambda n: store.read(f"raw.{n}")
    A = quality.Assertion
    return [
        *[A(f"{model}: {key} is unique", lambda m=model, k=key: quality.unique(relation(store, m), k)) for model, key in UNIQUE],
        *[A(f"{model}: {col} is in {parent}", lambda m=model, c=col, p=parent: quality.relationships(relation(store, m), c, relation(store, p), c), severity) for model, col, parent, severity in RELATIONS],
        A("patient version is unique", lambda: quality.unique(r("dim_patient"), "patient_id", "valid_from")),
        A("one current version", lambda: quality.unique(r("dim_patient"), "patient_id", where=F.col("is_current"))),
        A("versions tile", lambda: quality.version_gaps(r("dim_patient"), "patient_id")),
        A("versions record a change", lambda: quality.idle_versions(r("dim_patient"), "patient_id", CHECKED)),
        A("child counts reconcile", lambda: quality.child_totals_differ(r("fct_encounter"), condition_count=raw("conditions"), medication_count=raw("medications"))),
        A("restatements are absorbed", lambda: quality.unabsorbed_restatements(r("fct_claim"), store.read("meta.injection_log"))),
        A("denominator is complete", lambda: readmission.denominator_gaps(r("fct_encounter"), r("fct_readmission"))),
        A("readmission is the earliest", lambda: readmission.minimum_gaps(r("fct_encounter"), r("fct_readmission")).where(~F.col("days_to_readmission").eqNullSafe(F.col("recomputed_gap")))),
    ]


def data_tests(store: Store) -> DataFrame:
    """Violations of every declared test: those on single rows in one pass a model, and the assertions."""
    rows = []
    for model, columns in NOT_NULL.items():
        wrong = {f"{c} is given": F.col(c).isNull() for c in columns.split()}
        for c, values in ACCEPTED.get(model, {}).items():
            wrong[f"{c} is known"] = ~F.col(c).isin(values)
        for c, (low, high) in RANGES.get(model, {}).items():
            wrong[f"{c} is in range"] = ~F.col(c).between(low, high)
        rows.append(quality.column_summary(relation(store, model), model, wrong))
    return reduce(DataFrame.unionByName, rows, quality.summary(assertions(store)))


CHECKS: dict[str, tuple[str | None, Callable]] = {}


def check(name: str, needs: str | None = None):
    """Register a check against figures from outside the models; needs names the figure without which it is left out."""

    def add(fn):
        CHECKS[name] = (needs, fn)
        return fn

    return add


@check("merge-reached-an-earlier-build")
def _reached(store: Store, _) -> str | None:
    many = store.read("raw.claims").groupBy("claim_id").agg(F.countDistinct("_loaded_at").alias("n")).where("n > 1")
    return "no claim arrived in more than one landing" if many.isEmpty() else None


@check("snapshot-captured-the-payer-changes", "versioned")
def _captured(store: Store, versioned: int) -> str | None:
    n = store.read("mart.dim_patient").groupBy("patient_id").count().where("count > 1").count()
    return None if n == versioned else f"{n} keys hold several versions, not {versioned}"


@check("nothing-written-from-a-backwards-window", "backwards")
def _backwards(store: Store, day: datetime) -> str | None:
    n = store.read("mart.dim_patient").where(F.col("valid_from") == F.lit(day).cast("timestamp_ntz")).count()
    return f"{n} versions are dated {day:%Y-%m-%d}" if n else None


@check("snapshot-ran-once-per-window", "as_of")
def _once(store: Store, as_of: list[date]) -> str | None:
    days = [r[0].date() for r in store.read("mart.dim_patient").select("valid_from").distinct().orderBy("valid_from").collect()]  # one row a landing
    return None if days == as_of else f"captured {', '.join(map(str, days))}"


@check("readmissions-match-the-export", "measured")
def _measured(store: Store, measured: tuple[int, int]) -> str | None:
    row = store.read("mart.fct_readmission").agg(F.count(F.lit(1)), F.count_if("is_readmitted")).first()
    return None if tuple(row) == measured else f"{row[1]} over {row[0]}"


def warehouse_checks(store: Store, versioned: int | None = None, backwards: datetime | None = None, as_of: list | None = None, measured: tuple[int, int] | None = None) -> dict[str, str | None]:
    """Every registered check whose figure is given: a reason, or None when it holds."""
    given = {"versioned": versioned, "backwards": backwards, "as_of": as_of, "measured": measured}
    return {name: fn(store, given.get(needs)) for name, (needs, fn) in CHECKS.items() if needs is None or given[needs] is not None}


def main(argv: list[str] | None = None) -> int:
    """python -m tidemark.plans.warehouse build|test|check|freshness|lineage|vacuum --store DIR [--select X+ ...] [--exclude X+ ...] [--full-refresh] [--require-fresh] [--versioned N] [--backwards D] [--as-of D ...] [--measured N N]."""
    from tidemark.session import get_session

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("what", choices=["build", "test", "check", "freshness", "lineage", "vacuum"])
    parser.add_argument("--store")
    parser.add_argument("--select", nargs="*")
    parser.add_argument("--exclude", nargs="*", default=[])
    parser.add_argument("--full-refresh", action="store_true")
    parser.add_argument("--require-fresh", action="store_true")
    parser.add_argument("--versioned", type=int)
    parser.add_argument("--backwards", type=datetime.fromisoformat)
    parser.add_argument("--as-of", type=date.fromisoformat, nargs="*")
    parser.add_argument("--measured", type=int, nargs=2)
    args = parser.parse_args(argv)
    if args.what == "lineage":
        print(GRAPH.lineage())
        return 0
    store = Store(get_session("warehouse"), args.store)
    now = datetime.now(timezone.utc)
    if args.what == "build":
        print(build(store, args.select, args.exclude, args.full_refresh, now if args.require_fresh else None))
        return 0
    if args.what == "vacuum":
        print(store.vacuum())
        return 0
    if args.what == "freshness":
        rows = freshness(store, now).collect()
        for row in rows:
            print(row["source"], row["newest"], row["status"])
        return int(any(row["status"] == "error" for row in rows))
    if args.what == "check":
        found = warehouse_checks(store, args.versioned, args.backwards, args.as_of, tuple(args.measured) if args.measured else None)
        for name, reason in found.items():
            print("ok  " if reason is None else "FAIL", name, reason or "")
        return int(any(found.values()))
    rows = data_tests(store).collect()
    for row in rows:
        print(row["assertion"], row["severity"], row["violations"])
    return int(any(row["violations"] and row["severity"] == "error" for row in rows))


if __name__ == "__main__":
    raise SystemExit(main())
