"""Queries over the driver's tables, each beside the SQL that says the same.

The tables hold no health records, so orders stand for encounters, customers for patients, urgent
orders for stays, and line items for an append log of arrivals keyed by (order, line).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import days_between, round2
from tidemark.operators import claims, facts, history, quality, readmission, upsert
from tidemark.operators.patients import covering, version_at
from tidemark.operators.window import DateWindow, inherit_window, window_keys
from tidemark.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WINDOW = DateWindow(date(1998, 1, 1), date(1998, 2, 1))
AS_OF = [date(y, 1, 1) for y in (1996, 1997, 1998, 1999)]
RULE = claims.Restatement(seed=42)


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def encounters(spark: SparkSession, d: str) -> DataFrame:
    """Orders in the shape of encounters."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "inpatient").otherwise("ambulatory").alias("encounter_class"),
        F.col("o_orderdate").alias("started_at"), F.date_add(day, 4).alias("stopped_at"), day.alias("_service_date"),
    )


ENCOUNTERS = """enc AS (SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, o_orderpriority = '1-URGENT' AS stay,
  o_orderdate::date AS admit_date, (o_orderdate::date + 4) AS discharge_date FROM orders)"""
MEASURE = ENCOUNTERS + """, measure AS (
  SELECT i.encounter_id AS index_encounter_id, i.patient_id, i.admit_date, i.discharge_date, r.encounter_id AS readmission_encounter_id,
    date_diff('day', i.discharge_date, r.admit_date) AS days_to_readmission, r.encounter_id IS NOT NULL AS is_readmitted
  FROM (SELECT * FROM enc WHERE stay AND date_diff('day', discharge_date, (SELECT max(admit_date) FROM enc)) >= 30) i
  LEFT JOIN (SELECT * FROM enc WHERE stay) r ON r.patient_id = i.patient_id AND date_diff('day', i.discharge_date, r.admit_date) BETWEEN 1 AND 30
  QUALIFY row_number() OVER (PARTITION BY i.encounter_id ORDER BY r.admit_date, r.encounter_id) = 1)"""


@query(f"WITH {MEASURE} SELECT * FROM measure")
def readmission_measure(spark, d):
    return readmission.readmissions(encounters(spark, d))


@query(f"WITH {MEASURE} SELECT year(admit_date) AS admit_year, c_mktsegment AS segment, count(*) AS index_admissions, sum(is_readmitted::int)::bigint AS readmissions, sum(is_readmitted::int)::double / count(*) AS rate FROM measure JOIN customer ON c_custkey = patient_id GROUP BY ALL")
def readmission_rate(spark, d):
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("segment"))
    measure = readmission.readmissions(encounters(spark, d)).join(who, "patient_id")
    return readmission.readmission_rate(measure.withColumn("admit_year", F.year("admit_date").cast("bigint")), "admit_year", "segment")


def _beside(*counted: tuple[DataFrame, str]) -> DataFrame:
    """One row with the number of rows of each frame."""
    first, *rest = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in counted]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rest, first)


@query(f"""WITH {MEASURE}, due AS (SELECT encounter_id FROM enc WHERE stay AND date_diff('day', discharge_date, (SELECT max(admit_date) FROM enc)) >= 30),
  planted AS (SELECT CASE WHEN index_encounter_id % 97 = 1 THEN -index_encounter_id ELSE index_encounter_id END AS index_encounter_id FROM measure WHERE index_encounter_id % 97 <> 0)
  SELECT (SELECT count(*) FROM measure) AS index_rows,
    (SELECT count(*) FROM due FULL JOIN measure ON index_encounter_id = encounter_id WHERE encounter_id IS NULL OR index_encounter_id IS NULL) AS gaps,
    (SELECT count(*) FROM due FULL JOIN planted ON index_encounter_id = encounter_id WHERE encounter_id IS NULL OR index_encounter_id IS NULL) AS planted_gaps""")
def denominator_complete(spark, d):
    """The check over the measure, and over one with rows missing and strange rows added."""
    e, key = encounters(spark, d), F.col("index_encounter_id")
    m = readmission.readmissions(e)
    planted = m.where(key % 97 != 0).withColumn("index_encounter_id", F.when(key % 97 == 1, -key).otherwise(key))
    return _beside((m, "index_rows"), (readmission.denominator_gaps(e, m), "gaps"), (readmission.denominator_gaps(e, planted), "planted_gaps"))


@query(f"""WITH {MEASURE} SELECT m.index_encounter_id, m.days_to_readmission, min(date_diff('day', m.discharge_date, e.admit_date)) AS recomputed_gap
  FROM measure m LEFT JOIN enc e ON e.patient_id = m.patient_id AND e.stay AND date_diff('day', m.discharge_date, e.admit_date) BETWEEN 1 AND 30 GROUP BY 1, 2""")
def earliest_qualifying(spark, d):
    e = encounters(spark, d)
    return readmission.minimum_gaps(e, readmission.readmissions(e))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, o_orderdate::date AS service_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-02-01'""")
def window_landing(spark, d):
    keys = window_keys(table(spark, d, "orders"), "o_orderkey", "o_orderdate", WINDOW)
    rows = inherit_window(table(spark, d, "lineitem"), keys, "l_orderkey").withColumnRenamed("_service_date", "service_date")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "service_date")


@query("""SELECT 'supplier' AS kind, s_suppkey::varchar AS id, s_name AS name, n_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part', p_partkey::varchar, p_name, p_brand FROM part""")
def staging_projection(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("place"))
    s = table(spark, d, "supplier").join(n, "s_nationkey").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), "place")
    p = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("place"))
    return s.unionByName(p)


LINES = ["l_linenumber", "l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"]
R2 = "(sign({0}) * floor(abs({0}) * 100 + 0.5) / 100)"
APPORTIONED = f"""apportioned AS (
  SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_partkey, l_suppkey, o_orderdate,
    CASE WHEN seq < n THEN {R2.format("(o_totalprice / n)")} ELSE o_totalprice - {R2.format("(o_totalprice / n)")} * (n - 1) END AS billed_amount
  FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINES)}) AS seq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def apportioned(spark: SparkSession, d: str) -> DataFrame:
    """Each order's price split over its lines."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_orderdate")
    rows = table(spark, d, "lineitem").select("l_orderkey", *LINES).join(o, "l_orderkey")
    return claims.apportion(rows, "l_orderkey", LINES, {"o_totalprice": "billed_amount"})


@query(f"WITH {APPORTIONED} SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, l_partkey, l_suppkey, billed_amount FROM apportioned")
def apportioned_cost(spark, d):
    return apportioned(spark, d).select("l_orderkey", *LINES, "billed_amount")


@query(f"""WITH {APPORTIONED} SELECT count(*) AS orders_checked, sum((abs(total - o_totalprice) < 0.005)::int)::bigint AS reconciled
  FROM (SELECT l_orderkey, sum(billed_amount) AS total FROM apportioned GROUP BY 1) t JOIN orders ON o_orderkey = l_orderkey""")
def apportion_reconciles(spark, d):
    totals = apportioned(spark, d).groupBy("l_orderkey", "o_totalprice").agg(F.sum("billed_amount").alias("total"))
    return totals.agg(F.count(F.lit(1)).alias("orders_checked"), F.count_if(F.abs(F.col("total") - F.col("o_totalprice")) < 0.005).alias("reconciled"))


def restated(spark: SparkSession, d: str) -> DataFrame:
    """Orders as claims, with restated arrivals."""
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim_id"), day.alias("service_date"), F.date_add(day, 3).alias("received_date"),
        F.col("o_totalprice").alias("billed_amount"), round2(F.col("o_totalprice") * F.lit(0.8)).alias("payer_coverage"),
    )
    return claims.with_restatements(rows, "claim_id", RULE)


def _draw(tag: str, n: int) -> str:
    return f"(md5_number(claim_id::varchar || '|{tag}|42') % {n}::uint128)::int"


RESTATED = f"""orig AS (SELECT o_orderkey AS claim_id, o_orderdate::date AS service_date, o_orderdate::date + 3 AS received_date, o_totalprice AS billed_amount, {R2.format("(o_totalprice * 0.8::double)")} AS payer_coverage FROM orders),
 drawn AS (SELECT *, {_draw("restated", 100)} < 5 AS pick, {_draw("restatelag", 30)} + 1 AS lag, {_draw("factor", 50)} AS f FROM orig),
 scaled AS (SELECT *, CASE WHEN f < 25 THEN 0.75::double + f::double / 100 ELSE 1.01::double + (f - 25)::double / 100 END AS factor FROM drawn),
 arrivals AS (SELECT claim_id, service_date, received_date, date_diff('day', service_date, received_date)::int AS lag_days, billed_amount, payer_coverage, false AS is_restatement, NULL::double AS amount_before FROM scaled
  UNION ALL SELECT claim_id, service_date, received_date + lag, date_diff('day', service_date, received_date + lag)::int, {R2.format("(billed_amount * factor)")}, {R2.format("(payer_coverage * factor)")}, true, billed_amount FROM scaled WHERE pick)"""


@query(f"WITH {RESTATED} SELECT * FROM arrivals")
def restated_arrivals(spark, d):
    return restated(spark, d).select("claim_id", "service_date", "received_date", "lag_days", "billed_amount", "payer_coverage", "is_restatement", "amount_before")


@query(f"WITH {RESTATED} SELECT claim_id, service_date, received_date, lag_days, is_restatement, amount_before, billed_amount AS amount_after FROM arrivals")
def injection_log(spark, d):
    return claims.injection_log(restated(spark, d).withColumn("encounter_id", F.col("claim_id"))).drop("encounter_id")


@query(f"""WITH {RESTATED}, fact AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY received_date DESC) = 1),
  newest AS (SELECT claim_id, billed_amount AS amount_after, is_restatement FROM arrivals QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY received_date DESC, is_restatement DESC, billed_amount DESC) = 1)
  SELECT (SELECT count(*) FROM arrivals WHERE is_restatement) AS restated_claims,
    (SELECT count(*) FROM fact JOIN newest n USING (claim_id) WHERE n.is_restatement AND abs(billed_amount - amount_after) >= 0.005) AS unabsorbed,
    (SELECT count(*) FROM fact JOIN newest n USING (claim_id) WHERE n.is_restatement AND abs(CASE WHEN claim_id % 7 = 0 THEN billed_amount + 1 ELSE billed_amount END - amount_after) >= 0.005) AS planted_unabsorbed""")
def absorbed_restatements(spark, d):
    """The check over the fact, and over one in which every seventh claim shows another amount."""
    arrivals = restated(spark, d)
    fact = facts.claim_fact(arrivals)
    log = claims.injection_log(arrivals.withColumn("encounter_id", F.col("claim_id")))
    planted = fact.withColumn("billed_amount", F.when(F.col("claim_id") % 7 == 0, F.col("billed_amount") + 1).otherwise(F.col("billed_amount")))
    return _beside((log.where("is_restatement"), "restated_claims"), (quality.unabsorbed_restatements(fact, log), "unabsorbed"), (quality.unabsorbed_restatements(planted, log), "planted_unabsorbed"))


@query(f"""WITH {RESTATED} SELECT o.claim_id, date_diff('day', o.received_date, r.received_date) AS days_later, o.billed_amount AS amount_first, r.billed_amount AS amount_last, r.amount_before = o.billed_amount AS agrees
  FROM arrivals o JOIN arrivals r ON o.claim_id = r.claim_id WHERE NOT o.is_restatement AND r.is_restatement""")
def restatement_pairs(spark, d):
    """Each restated claim's two arrivals, by a join of the log with itself."""
    return claims.restatement_pairs(claims.injection_log(restated(spark, d).withColumn("encounter_id", F.col("claim_id"))))


@query("""SELECT c_custkey, e.event_type AS state, e.ts AS since FROM customer LEFT JOIN
  (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM events) e
  ON e.user_id = c_custkey AND e.ts::date <= DATE '2024-01-05' AND (e.until IS NULL OR e.until::date > DATE '2024-01-05')""")
def as_of_state(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    spans = table(spark, d, "events").select("user_id", "event_type", "ts", F.lead("ts").over(w).alias("until"))
    held = covering(spans, "ts", "until", F.lit(date(2024, 1, 5)))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(held, c["c_custkey"] == held["user_id"], "left").select("c_custkey", F.col("event_type").alias("state"), F.col("ts").alias("since"))


@query("""SELECT o_orderkey AS encounter_id, o_totalprice - coalesce(a.n, 0) AS responsibility, coalesce(a.n, 0) AS returned_lines, coalesce(b.n, 0) AS other_lines FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON a.l_orderkey = o_orderkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) b ON b.l_orderkey = o_orderkey""")
def order_fact(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), "l_returnflag")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("encounter_id"), "o_totalprice")
    fact = facts.with_child_counts(orders, "encounter_id", returned_lines=lines.where("l_returnflag = 'R'"), other_lines=lines.where("l_returnflag <> 'R'"))
    return fact.select("encounter_id", (F.col("o_totalprice") - F.col("returned_lines")).alias("responsibility"), "returned_lines", "other_lines")


@query("""WITH fact AS (SELECT o_orderkey, coalesce(r, 0) AS r, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
  held AS (SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS r, (SELECT count(*) FROM lineitem) AS n),
  have AS (SELECT sum(r)::bigint AS r, sum(n)::bigint AS n, sum(r) FILTER (o_orderkey % 5 <> 0) AS pr, sum(n) FILTER (o_orderkey % 5 <> 0) AS pn FROM fact)
  SELECT have.r AS returned_lines, have.n AS all_lines, (have.r <> held.r)::bigint + (have.n <> held.n)::bigint AS mismatches, (pr <> held.r)::bigint + (pn <> held.n)::bigint AS planted_mismatches FROM have, held""")
def child_reconcile(spark, d):
    """The check over the fact, and over one without a fifth of its orders."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), "l_returnflag")
    returned = lines.where("l_returnflag = 'R'")
    fact = facts.with_child_counts(table(spark, d, "orders").select(F.col("o_orderkey").alias("encounter_id")), "encounter_id", returned_lines=returned, all_lines=lines)
    differ = lambda rows: quality.child_totals_differ(rows, returned_lines=returned, all_lines=lines)
    wrong = _beside((differ(fact), "mismatches"), (differ(fact.where("encounter_id % 5 <> 0")), "planted_mismatches"))
    return fact.agg(F.sum("returned_lines").alias("returned_lines"), F.sum("all_lines").alias("all_lines")).crossJoin(F.broadcast(wrong))


KEYS = ["l_orderkey", "l_linenumber"]


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC) = 1")
def latest_arrival(spark, d):
    rows = table(spark, d, "lineitem").select(*KEYS, "l_shipdate", "l_extendedprice")
    return upsert.latest_per_key(rows, KEYS, [F.desc("l_shipdate"), F.desc("l_extendedprice")])


def _folded(spark: SparkSession, d: str, windows: list[DateWindow]) -> DataFrame:
    rows = table(spark, d, "lineitem").select(*KEYS, "l_shipdate", "l_extendedprice")
    parts = [rows.where(w.holds(F.col("l_shipdate").cast("date"))) for w in windows]
    held = upsert.latest_per_key(parts[0], KEYS, [F.desc("l_shipdate"), F.desc("l_extendedprice")])
    return reduce(lambda h, b: upsert.merge_latest(h, b, KEYS, "l_shipdate", [F.desc("l_extendedprice")]), parts[1:], held)


LANDINGS = [DateWindow(date(1900, 1, 1), date(1997, 1, 1)), DateWindow(date(1997, 1, 1), date(1999, 1, 1)), DateWindow(date(1999, 1, 1), date(2100, 1, 1))]


@query(ORACLES["latest_arrival"])
def incremental_merge(spark, d):
    return _folded(spark, d, LANDINGS)


@query(ORACLES["latest_arrival"])
def incremental_merge_reversed(spark, d):
    return _folded(spark, d, LANDINGS[::-1])


STATES = """states AS (SELECT o_custkey AS customer, a.as_of, o_orderstatus AS status FROM orders, (SELECT unnest([TIMESTAMP '1996-01-01', TIMESTAMP '1997-01-01', TIMESTAMP '1998-01-01', TIMESTAMP '1999-01-01']) AS as_of) a
   WHERE o_orderdate::date <= a.as_of::date QUALIFY row_number() OVER (PARTITION BY o_custkey, a.as_of ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
 versions AS (SELECT customer, status, as_of AS valid_from, lead(as_of) OVER (PARTITION BY customer ORDER BY as_of) AS valid_to
   FROM (SELECT *, lag(status) OVER (PARTITION BY customer ORDER BY as_of) AS prev, row_number() OVER (PARTITION BY customer ORDER BY as_of) AS k FROM states) WHERE k = 1 OR status IS DISTINCT FROM prev)"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's latest status as of four dates: the latest order by the first date that sees it, then of all dates before."""
    seen = F.least(*[F.when(F.col("o_orderdate").cast("date") <= F.lit(a), F.lit(a)) for a in AS_OF], F.lit(None).cast("date"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), "o_orderdate", "o_orderkey", "o_orderstatus", seen.alias("first")).where(F.col("first").isNotNull())
    opened = rows.groupBy("customer", "first").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))  # as many rows as dates
    later = F.explode(F.filter(F.array(*[F.lit(a) for a in AS_OF]), lambda a: F.col("first") <= a))
    last = opened.select("customer", "m", later.alias("as_of")).groupBy("customer", "as_of").agg(F.max("m").alias("m"))
    return last.select("customer", F.col("as_of").cast("timestamp_ntz").alias("as_of"), F.col("m.o_orderstatus").alias("status"))


@query(f"WITH {STATES} SELECT * FROM versions")
def scd2_history(spark, d):
    return history.versions_of(_states(spark, d), "customer", ["status"], "as_of")


@query(f"WITH {STATES} SELECT * FROM versions")
def scd2_fold(spark, d):
    states, held = _states(spark, d), None
    for day in AS_OF:
        state = states.where(F.col("as_of") == F.lit(day).cast("timestamp_ntz")).drop("as_of")
        held = history.fold_snapshot(held, state, "customer", ["status"], day)
    return held


@query(f"WITH {STATES} SELECT customer, status, valid_from, valid_to, valid_to IS NULL AS is_current FROM versions")
def dim_projection(spark, d):
    v = history.versions_of(_states(spark, d), "customer", ["status"], "as_of")
    return v.select("customer", "status", "valid_from", "valid_to", history.is_current())


@query(f"WITH {STATES} SELECT o_orderkey, o_custkey AS customer, status, valid_from FROM orders LEFT JOIN versions ON customer = o_custkey AND valid_from <= o_orderdate AND (valid_to IS NULL OR valid_to > o_orderdate)")
def point_in_time_lookup(spark, d):
    v = history.versions_of(_states(spark, d), "customer", ["status"], "as_of")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), "o_orderdate")
    return version_at(o, v, "customer", "o_orderdate").select("o_orderkey", "customer", "status", "valid_from")


@query(f"""WITH {STATES}, w AS (SELECT *, lead(valid_from) OVER (PARTITION BY customer ORDER BY valid_from) AS next_from, lag(status) OVER (PARTITION BY customer ORDER BY valid_from) AS prev,
    row_number() OVER (PARTITION BY customer ORDER BY valid_from) AS k FROM versions)
  SELECT count(*) AS versions_checked, count(*) FILTER (valid_to IS DISTINCT FROM next_from) AS gaps, count(*) FILTER (k > 1 AND status IS NOT DISTINCT FROM prev) AS idle,
    count(*) FILTER ((CASE WHEN customer % 3 = 0 THEN valid_to + INTERVAL 1 DAY ELSE valid_to END) IS DISTINCT FROM next_from) AS planted_gaps, count(*) FILTER (k > 1) AS planted_idle FROM w""")
def version_tiling(spark, d):
    """The checks over the versions, and over some that end a day late or never change."""
    v = history.versions_of(_states(spark, d), "customer", ["status"], "as_of")
    late = v.withColumn("valid_to", F.when(F.col("customer") % 3 == 0, F.col("valid_to") + F.expr("interval 1 day")).otherwise(F.col("valid_to")))
    gaps, idle = (lambda df: quality.version_gaps(df, "customer")), (lambda df: quality.idle_versions(df, "customer", ["status"]))
    return _beside((v, "versions_checked"), (gaps(v), "gaps"), (idle(v), "idle"), (gaps(late), "planted_gaps"), (idle(v.withColumn("status", F.lit("F"))), "planted_idle"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_anti(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_exists(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("""SELECT 'order key is unique' AS assertion, 'error' AS severity, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS violations
 UNION ALL SELECT 'line key is unique', 'warn', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1))
 UNION ALL SELECT 'customer is given', 'error', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)
 UNION ALL SELECT 'order of a line exists', 'error', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
 UNION ALL SELECT 'status is known', 'error', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
 UNION ALL SELECT 'discount is in range', 'error', (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.05)""")
def quality_summary(spark, d):
    orders, lines, A = table(spark, d, "orders"), table(spark, d, "lineitem"), quality.Assertion
    return quality.summary([
        A("order key is unique", lambda: quality.unique(orders, "o_orderkey")), A("line key is unique", lambda: quality.unique(lines, *KEYS), "warn"),
        A("customer is given", lambda: quality.not_null(orders, "o_custkey")), A("order of a line exists", lambda: quality.relationships(lines, "l_orderkey", orders, "o_orderkey")),
        A("status is known", lambda: quality.accepted_values(orders, "o_orderstatus", ["F", "O"])), A("discount is in range", lambda: quality.accepted_range(lines, "l_discount", 0, 0.05)),
    ])


@query("""SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS orders_seen, min(lag) AS least, max(lag) AS most, median(lag) AS middle, count(*) FILTER (lag > 30) AS late,
  100.0::double * count(*) FILTER (lag > 30) / count(DISTINCT l_orderkey) AS late_rate
  FROM (SELECT l_orderkey, date_diff('day', o_orderdate::date, l_shipdate::date) AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def lag_distribution(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lag = days_between(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(o, "l_orderkey").select("l_orderkey", lag.alias("lag"))
    return rows.agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("l_orderkey").alias("orders_seen"), F.min("lag").alias("least"), F.max("lag").alias("most"),
        F.percentile("lag", 0.5).alias("middle"), F.count_if(F.col("lag") > 30).alias("late"),
        (F.lit(100.0) * F.count_if(F.col("lag") > 30) / F.countDistinct("l_orderkey")).alias("late_rate"),
    )


@query("""SELECT 'orders' AS tab, max(o_orderdate) AS newest, date_diff('second', max(o_orderdate), TIMESTAMP '2001-08-02 12:00:00') / 3600.0::double AS age_hours,
  CASE WHEN date_diff('second', max(o_orderdate), TIMESTAMP '2001-08-02 12:00:00') / 3600.0::double > 48 THEN 'error' WHEN date_diff('second', max(o_orderdate), TIMESTAMP '2001-08-02 12:00:00') / 3600.0::double > 24 THEN 'warn' ELSE 'pass' END AS status FROM orders""")
def freshness_status(spark, d):
    now = F.lit("2001-08-02 12:00:00").cast("timestamp_ntz")
    return quality.freshness(table(spark, d, "orders"), "o_orderdate", now).withColumn("tab", F.lit("orders"))


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_shipdate) AS landings, count(*) AS arrivals FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_shipdate) > 1")
def multi_landing_keys(spark, d):
    return table(spark, d, "lineitem").groupBy(*KEYS).agg(F.countDistinct("l_shipdate").alias("landings"), F.count(F.lit(1)).alias("arrivals")).where("landings > 1")


@query("SELECT DISTINCT o_orderdate::date AS landed_on FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-02-01' ORDER BY 1")
def distinct_landings(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").where(WINDOW.holds(day)).select(day.alias("landed_on")).distinct().orderBy("landed_on")


@query(f"""WITH {ENCOUNTERS}, first_seen AS (SELECT patient_id, min(admit_date) AS first_stay FROM enc WHERE stay GROUP BY 1)
  SELECT patient_id, first_stay, first_stay IS NOT NULL AND first_stay <= DATE '1998-01-01' AS seen FROM (SELECT c_custkey AS patient_id FROM customer) LEFT JOIN first_seen USING (patient_id)""")
def null_safe_flags(spark, d):
    first = readmission.stays(encounters(spark, d)).groupBy("patient_id").agg(F.min("admit_date").alias("first_stay"))
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"))
    seen = F.col("first_stay").isNotNull() & (F.col("first_stay") <= F.lit(date(1998, 1, 1)))
    return who.join(first, "patient_id", "left").withColumn("seen", F.coalesce(seen, F.lit(False)))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem WHERE l_shipdate < DATE '1998-01-01' OR l_shipdate >= DATE '1998-02-01' UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice * 2 FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-02-01'")
def window_replace(spark, d):
    from tidemark.operators.window import replace_window

    rows = table(spark, d, "lineitem").select(*KEYS, "l_shipdate", "l_extendedprice")
    again = rows.where(WINDOW.holds(F.col("l_shipdate"))).withColumn("l_extendedprice", F.col("l_extendedprice") * 2)
    return replace_window(rows, again, "l_shipdate", WINDOW)
