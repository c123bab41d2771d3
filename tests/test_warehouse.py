"""Landing, history, merge, checks and graph over a generated export."""

from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import history, quality, readmission
from tidemark.operators.patients import patients_as_of
from tidemark.operators.window import DateWindow
from tidemark.plans import warehouse
from tidemark.plans.graph import Graph
from tidemark.sources.landing import land_window
from tidemark.sources.readers import csv_to_parquet
from tidemark.sources.store import Store
from tidemark.streaming.upsert import upsert_stream
from tidemark.testing.export import write_export

WINDOWS = [(date(1900, 1, 1), date(2025, 10, 1)), (date(2025, 10, 1), date(2025, 11, 15)), (date(2025, 11, 15), date(2026, 6, 1))]


@pytest.fixture(scope="module")
def export(tmp_path_factory):
    return write_export(str(tmp_path_factory.mktemp("export")))


@pytest.fixture(scope="module")
def built(spark, export, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    reports = []
    for start, end in WINDOWS:
        reports.append(land_window(spark, store, export, start, end))
        warehouse.build(store)
    return store, reports


def rows(df):
    return sorted(map(str, df.select(*[c for c in sorted(df.columns) if c != "_loaded_at"]).collect()))


def test_window_rejects_an_inverted_range():
    with pytest.raises(ValueError):
        DateWindow(date(2025, 1, 2), date(2025, 1, 2))


def test_windows_tile_and_reports_match(spark, export, built):
    store, reports = built
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("encounters", "conditions", "medications"):
        assert store.read(f"raw.{name}").count() == sum(r.rows[name] for r in reports) == con.sql(f"SELECT count(*) FROM '{export}/{name}.parquet'").fetchall()[0][0]
    late = store.read("raw.conditions").where("START < _service_date").count()
    assert late > 0  # children keep their parent's date
    assert store.read("raw.encounters").where(F.col("_service_date") != F.col("START").cast("date")).count() == 0


def test_landing_again_and_in_reverse_gives_the_same(spark, export, built, tmp_path):
    store, _ = built
    land_window(spark, store, export, *WINDOWS[1])
    other = Store(spark, str(tmp_path / "reverse"))
    for start, end in WINDOWS[::-1]:
        land_window(spark, other, export, start, end)
    for name in ("raw.encounters", "raw.conditions", "raw.claims", "meta.injection_log"):
        assert rows(store.read(name)) == rows(other.read(name))
    warehouse.build(other, ["fct_claim"])
    assert rows(warehouse.fct_claim(other.read("raw.claims"))) == rows(other.read("mart.fct_claim"))
    land_window(spark, store, export, *WINDOWS[2])  # leaves the patients as of the last window's end


def test_an_empty_window_lands_nothing(spark, export, tmp_path):
    report = land_window(spark, Store(spark, str(tmp_path / "s")), export, date(1900, 1, 1), date(1900, 1, 2))
    assert {report.rows[n] for n in ("encounters", "conditions", "medications", "claims")} == {0} and report.rows["payers"] == 3


def test_a_failed_load_leaves_the_old_state(spark, export, built):
    store, _ = built
    before = store.manifest()
    broken = spark.range(3).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))
    with pytest.raises(Exception, match="boom"):
        store.commit({"raw.encounters": spark.range(1), "raw.claims": broken})
    assert store.manifest() == before


def test_claims(spark, export, built):
    store, _ = built
    claims, log = store.read("raw.claims"), store.read("meta.injection_log")
    assert claims.count() == log.count()
    original = log.where("not is_restatement").groupBy("encounter_id").agg(F.sum("amount_after").alias("total"))
    cost = spark.read.parquet(f"{export}/encounters.parquet").select(F.col("Id").alias("encounter_id"), "TOTAL_CLAIM_COST")
    assert original.join(cost, "encounter_id").where(F.abs(F.col("total") - F.col("TOTAL_CLAIM_COST")) > 0.005).count() == 0
    assert claims.where(F.col("payer_coverage") > F.col("billed_amount") + 0.005).count() == 0
    restated = log.where("is_restatement")
    share = restated.count() / log.where("not is_restatement").count()
    assert 0.02 < share < 0.08 and restated.where("amount_after = amount_before").count() == 0
    pairs = restated.alias("r").join(log.where("not is_restatement").alias("o"), "claim_id").select(F.datediff("r.received_date", "o.received_date").alias("lag"))
    assert pairs.where("lag not between 1 and 30").count() == 0


def test_merge_equals_full_refresh(spark, built):
    store, _ = built
    merged = rows(store.read("mart.fct_claim"))
    assert merged == rows(warehouse.fct_claim(store.read("raw.claims")))


def test_patients_as_of(spark, export):
    people, spans = spark.read.parquet(f"{export}/patients.parquet"), spark.read.parquet(f"{export}/payer_transitions.parquet")
    day = date(2025, 9, 30)  # 60 days after the first: someone is born on it
    now = patients_as_of(people, spans, day)
    assert now.count() == now.select("patient_id").distinct().count() == people.where(F.col("BIRTHDATE") <= F.lit(day)).count()
    assert now.where(F.col("birthdate") == F.lit(day)).count() > 0 and now.where("payer_id is null or is_deceased").count() == 0
    later = patients_as_of(people, spans, date(2025, 12, 31))
    assert later.where("is_deceased").count() > 0 and later.where("is_deceased <> (deceased_date is not null)").count() == 0
    moved = now.join(later.select("patient_id", F.col("payer_id").alias("new")), "patient_id").where("payer_id <> new").count()
    assert moved > 0


def test_history_and_guard(spark, export, built):
    store, _ = built
    dim = store.read("mart.dim_patient")
    assert dim.groupBy("patient_id").count().where("count > 1").count() > 0
    assert quality.version_gaps(dim, "patient_id").count() == 0
    with pytest.raises(history.BackwardsAsOf):
        history.refuse_backwards(dim, date(2025, 10, 15))
    history.refuse_backwards(dim, date(2026, 6, 1))
    again = history.fold_snapshot(store.read("mart.snap_patient"), store.read("raw.patients_current").drop("_as_of_date", "_loaded_at"), "patient_id", warehouse.CHECKED, date(2026, 6, 1))
    assert rows(again) == rows(store.read("mart.snap_patient"))


def test_all_assertions_hold(spark, built):
    store, _ = built
    found = {r["assertion"]: (r["severity"], r["violations"]) for r in warehouse.data_tests(store).collect()}
    assert all(n == 0 for severity, n in found.values() if severity == "error"), found
    assert len(found) == 71  # 65 declared on models, and six assertions between them
    checks = warehouse.warehouse_checks(store, backwards=datetime(2025, 10, 15), as_of=[end for _, end in WINDOWS[:2]], measured=(-1, 0))
    assert checks["nothing-written-from-a-backwards-window"] is None and checks["snapshot-ran-once-per-window"] is None
    assert checks["readmissions-match-the-export"] is not None


def folders(store, name):
    return {k: p["folder"] for k, p in store.manifest()[name]["parts"].items()}


def test_a_month_rewrites_its_own_files_only(spark, export, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    land_window(spark, store, export, date(2025, 8, 1), date(2025, 12, 1))
    warehouse.build(store, ["fct_claim"])
    before = {n: folders(store, n) for n in ("raw.encounters", "raw.claims", "mart.fct_claim")}
    land_window(spark, store, export, date(2025, 10, 1), date(2025, 11, 1))
    for name in ("raw.encounters", "raw.claims"):
        after = folders(store, name)
        assert {k for k in after if after[k] != before[name][k]} == {"2025-10"} and after.keys() == before[name].keys()
    assert warehouse.build(store, ["fct_claim"])["mart.fct_claim"] == 0 and folders(store, "mart.fct_claim") == before["mart.fct_claim"]
    land_window(spark, store, export, date(2025, 12, 1), date(2025, 12, 3))
    warehouse.build(store, ["fct_claim"])
    now = folders(store, "mart.fct_claim")
    assert 0 < sum(now[k] != f for k, f in before["mart.fct_claim"].items()) < len(now)
    assert rows(store.read("mart.fct_claim")) == rows(warehouse.fct_claim(store.read("raw.claims")))


def test_of_two_commits_at_once_one_fails_and_none_is_lost(spark, tmp_path, monkeypatch):
    from tidemark.sources.store import ConcurrentCommit

    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    store.commit({"raw.a": spark.range(1)})
    publish = store._publish
    monkeypatch.setattr(store, "_publish", lambda *a: (other.commit({"raw.b": spark.range(2)}), publish(*a)))
    with pytest.raises(ConcurrentCommit):
        store.commit({"raw.a": spark.range(5)})
    assert store.read("raw.a").count() == 1 and store.read("raw.b").count() == 2
    other.commit({"raw.a": spark.range(7)})
    assert other.vacuum(keep=1) == 2 and other.read("raw.a").count() == 7 and other.read("raw.b").count() == 2
    with store.lock(), pytest.raises(ConcurrentCommit), other.lock():
        pass


def test_tables_are_there_before_the_first_landing(spark, export, tmp_path):
    from tidemark.sources.landing import create_tables

    store = Store(spark, str(tmp_path / "s"))
    names = create_tables(spark, store, export)
    assert len(names) == 8 and all(store.read(n).count() == 0 and store.read(n).columns for n in names)
    assert create_tables(spark, store, export) == []
    land_window(spark, store, export, *WINDOWS[0])
    assert store.read("raw.claims").count() > 0


def test_backfill_runs_by_month_and_retries(spark, export, tmp_path, monkeypatch):
    from datetime import timezone

    from tidemark.plans import backfill

    assert list(backfill.months(date(2025, 11, 15), date(2026, 1, 2))) == [(date(2025, 11, 15), date(2025, 12, 1)), (date(2025, 12, 1), date(2026, 1, 1)), (date(2026, 1, 1), date(2026, 1, 2))]
    failures, land = [OSError("lost")], backfill.land_window

    def landing(*a):
        if failures:
            raise failures.pop()
        return land(*a)

    monkeypatch.setattr(backfill, "land_window", landing)
    store = Store(spark, str(tmp_path / "s"))
    reports = backfill.backfill(spark, store, export, date(2025, 8, 1), date(2025, 10, 1), delay=0)
    assert [r.start for r in reports] == [date(2025, 8, 1), date(2025, 9, 1)] and store.read("mart.fct_claim").count() > 0
    failures += [OSError("lost")] * 3
    with pytest.raises(OSError, match="lost"):
        backfill.backfill(spark, store, export, date(2025, 10, 1), date(2025, 11, 1), delay=0)
    with pytest.raises(warehouse.StaleSource):
        warehouse.build(store, fresh_at=datetime(2100, 1, 1, tzinfo=timezone.utc))
    assert warehouse.require_fresh(store, datetime.now(timezone.utc)) == []


def test_check_command_tells_by_its_exit_code(spark, built, capsys):
    store, _ = built
    days = [str(end) for _, end in WINDOWS[:2]]
    assert warehouse.main(["check", "--store", store.root, "--as-of", *days]) == 0
    assert warehouse.main(["check", "--store", store.root, "--measured", "0", "1"]) == 1 and "FAIL readmissions-match" in capsys.readouterr().out
    assert warehouse.main(["freshness", "--store", store.root]) == 0


def test_planted_violations_are_found(spark, built):
    store, _ = built
    bad = store.read("mart.fct_encounter").withColumns({"payer_id": F.lit("nobody"), "patient_id": F.lit(None).cast("string")})
    held = store.manifest()
    store.commit({"mart.fct_encounter": bad.unionByName(bad.limit(1))})
    found = {r["assertion"]: r["violations"] for r in warehouse.data_tests(store).collect()}
    store._publish(held, store._versions()[-1] + 1)
    n = bad.count() + 1
    assert found["fct_encounter: payer_id is in dim_payer"] == found["fct_encounter: patient_id is given"] == n and found["fct_encounter: encounter_id is unique"] == 1
    assert quality.contract_breaches(bad, T.StructType(bad.schema.fields[::-1])) != []


DAY = datetime(2025, 1, 1)


def case(spark, *stays):
    data = [(i, "p", c, datetime(2025, *a), datetime(2025, *b)) for i, c, a, b in stays]
    df = spark.createDataFrame(data, "encounter_id string, patient_id string, encounter_class string, started_at timestamp_ntz, stopped_at timestamp_ntz")
    found = readmission.readmissions(df.withColumn("_service_date", F.col("started_at").cast("date"))).collect()
    return sorted((r["index_encounter_id"], r["readmission_encounter_id"], r["days_to_readmission"]) for r in found)


def test_readmission_boundaries(spark):
    i = "inpatient"
    assert case(spark, ("a", i, (1, 1), (1, 5)), ("b", i, (2, 4), (2, 6))) == [("a", "b", 30)]
    assert case(spark, ("a", i, (1, 1), (1, 5)), ("b", i, (1, 5), (1, 7)), ("c", "ambulatory", (3, 1), (3, 1))) == [("a", None, None), ("b", None, None)]
    assert case(spark, ("a", i, (1, 1), (1, 5)), ("b", i, (1, 15), (1, 16)), ("c", i, (1, 25), (1, 26)), ("d", "ambulatory", (4, 1), (4, 1))) == [("a", "b", 10), ("b", "c", 9), ("c", None, None)]
    assert case(spark, ("a", i, (1, 1), (1, 5)), ("b", i, (3, 1), (3, 5))) == [("a", None, None)]


def test_graph_selection():
    g = Graph()
    for name, inputs in (("a", ("raw.x",)), ("b", ("a",)), ("c", ("b",)), ("d", ("raw.y",))):
        g.model(name, *inputs)(lambda *_: None)
    assert g.select(["b+"]) == ["b", "c"] and set(g.select(exclude=["b+"])) == {"a", "d"}
    assert "a --> b" in g.lineage()
    with pytest.raises(KeyError):
        g.select(["nope+"])
    chosen = warehouse.GRAPH.select(exclude=["stg_patients_current+"])
    assert not {"snap_patient", "dim_patient"} & set(chosen) and "fct_claim" in chosen


def test_contract_and_freshness(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert quality.contract_breaches(df, df.schema) == []
    assert len(quality.contract_breaches(df, T.StructType([T.StructField("a", T.LongType()), T.StructField("c", T.StringType())]))) == 3
    stamped = spark.createDataFrame([(datetime(2025, 1, 1),)], "t timestamp_ntz")
    at = lambda s: quality.freshness(stamped, "t", F.lit(s).cast("timestamp_ntz")).first()["status"]
    assert [at("2025-01-01 10:00:00"), at("2025-01-02 10:00:00"), at("2025-01-04 10:00:00")] == ["pass", "warn", "error"]


def test_csv_conversion_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,ZIP\n1,01234\n")
    schema = T.StructType([T.StructField("Id", T.LongType()), T.StructField("ZIP", T.StringType())])
    assert csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"), schema).first()["ZIP"] == "01234"


def test_upsert_stream_admits_late_rows(spark, tmp_path):
    store, source = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    schema = "k string, received date, v int"
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    for batch in ([("a", date(2025, 3, 1), 1), ("b", date(2025, 3, 1), 2)], [("a", date(2025, 4, 1), 3), ("c", date(2025, 1, 1), 4), ("b", date(2025, 2, 1), 9)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        upsert_stream(stream(), store, "mart.latest", ["k"], "received", str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in store.read("mart.latest").collect()) == [("a", 3), ("b", 2), ("c", 4)]


def test_merge_is_admission_then_replacement(spark):
    from tidemark.operators import upsert

    schema = "k string, received date, v int"
    held = spark.createDataFrame([("a", date(2025, 3, 1), 1), ("b", date(2025, 3, 1), 2), ("d", date(2025, 3, 1), 7)], schema)
    batch = spark.createDataFrame([("a", date(2025, 3, 1), 9), ("b", date(2025, 3, 2), 3), ("b", date(2025, 3, 4), 5), ("c", None, 4), ("d", None, 8)], schema)
    admitted = upsert.latest_per_key(upsert.admit_newer(batch, held, ["k"], "received"), ["k"], [F.desc("received")])
    want = held.join(admitted.select("k"), "k", "left_anti").unionByName(admitted)
    assert rows(upsert.merge_latest(held, batch, ["k"], "received")) == rows(want)
