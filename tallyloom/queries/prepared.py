"""Queries of the data-preparation operators outside the llm subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import folded
from tallyloom.operators import features, intervals, wide
from tallyloom.queries.common import fold_sql, table
from tallyloom.session import new_scratch, partitions_for
from tallyloom.streaming import wide_ingest

PAYMENTS = 0  # the store's type of payments; causes have their ids from 1 on
SPANS = {"window": ("2000-01-01", "2019-12-31"), "ever": (None, None)}


def _accidents(spark: SparkSession, folder: str) -> DataFrame:
    """Accidents with the id of their cause, NULL where it is none of the reference's few hundred (their number is checked)."""
    causes = table(spark, folder, "cause_reference").select("cause_id", folded(F.col("accident_cause")).alias("key")).where("key is not null")
    if len(causes.limit(5001).collect()) > 5000:
        raise ValueError("more than 5000 causes")
    rows = table(spark, folder, "data_accidents").select("snz_uid", "accident_date", "loaded_at", folded(F.col("accident_cause")).alias("key"))
    return rows.join(F.broadcast(causes), "key", "left")


def _payments(spark: SparkSession, folder: str) -> DataFrame:
    """Different payments; loaded_at is that of the first record."""
    rows = table(spark, folder, "data_benefit_payment")
    return rows.groupBy("snz_uid", "benefit_start_date", "benefit_end_date", "payments").agg(F.min("loaded_at").alias("loaded_at"))


def _days(accidents: DataFrame, payments: DataFrame) -> DataFrame:
    return features.daily(accidents, "snz_uid", "cause_id", "accident_date").unionByName(
        features.daily(payments, "snz_uid", None, "benefit_start_date", "payments", PAYMENTS)
    )


def person_rows(spark: SparkSession, folder: str, spans: dict[str, features.Span]) -> DataFrame:
    """One map row per person: accidents by cause and payments, in each span."""
    store = features.cumulated(_days(_accidents(spark, folder), _payments(spark, folder)))
    return features.entity_rows(features.asof_features(store, spans), list(spans))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = person_rows(spark, folder, SPANS).where(F.element_at("by_type", F.lit(PAYMENTS))["ever"]["total"] >= 1000)
    each = rows.select(F.col("entity").alias("snz_uid"), F.explode("by_type").alias("cause_id", "f"))
    hit = (F.col("cause_id") != PAYMENTS) & (F.col("f.window.days") >= 3) & (F.col("f.window.last_day") >= F.lit("2019-01-01").cast("date"))
    return each.where(hit).select("snz_uid", "cause_id")


def _wide_features(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    ids = [r[0] for r in table(spark, folder, "cause_reference").select("cause_id").distinct().orderBy("cause_id").limit(5001).collect()]
    if len(ids) > 5000:
        raise ValueError("more than 5000 causes: use the map rows")
    paid = F.element_at("by_type", F.lit(PAYMENTS))["ever"]
    keep = [
        F.coalesce(F.col("untyped.ever.n"), F.lit(0)).alias("other_n"),
        F.coalesce(paid["n"], F.lit(0)).alias("payments_n"),
        paid["total"].alias("payments_total"),
    ]
    return features.wide_features(rows, "ever", ids, keep=keep).withColumnRenamed("entity", "snz_uid")


def p2_features(spark: SparkSession, folder: str) -> DataFrame:
    return _wide_features(spark, folder, person_rows(spark, folder, {"ever": (None, None)}))


#: The moment that parts the two loads of p2_store, and the span of p2_odd_amounts.
LOADED, YEARS = "2015-01-01", ("2010-01-01", "2018-06-30")


def p2_store(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of p2_features from a kept store to which the events were appended in two loads."""
    accidents, payments = _accidents(spark, folder), _payments(spark, folder)
    store = features.FeatureStore(spark, new_scratch(spark, "store"))
    early = F.coalesce(F.col("loaded_at") < F.lit(LOADED).cast("timestamp_ntz"), F.lit(True))
    for some in (early, ~early):
        store.append(_days(accidents.where(some), payments.where(some)))
    return _wide_features(spark, folder, features.entity_rows(features.asof_features(store.read(), {"ever": (None, None)}), ["ever"]))


def p2_odd_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Payments in YEARS per person, where payments before are made NaN, infinite or 1e17 larger, and zeros inside infinite."""
    day, paid = F.col("benefit_start_date"), F.col("payments")
    before = day < F.lit(YEARS[0]).cast("date")
    odd = F.when(before & (paid < 0), float("nan")).when(before & (paid > 1000), float("inf")).when(before, paid + 1e17)
    rows = table(spark, folder, "data_benefit_payment").withColumn("payments", odd.when(paid == 0, float("inf")).otherwise(paid))
    store = features.cumulative_store(rows, "snz_uid", None, "benefit_start_date", "payments", PAYMENTS)
    f = features.asof_features(store, {"years": YEARS})
    return f.where("years.n > 0").select(
        F.col("entity").alias("snz_uid"), "years.n", "years.days", "years.last_day", F.when(F.col("years.total") != float("inf"), F.col("years.total")).alias("total")
    )


def p3_periods(spark: SparkSession, folder: str) -> DataFrame:
    spells = table(spark, folder, "data_benefit_payment")
    both = intervals.periods_and_gaps(intervals.continuous_periods(spells, "snz_uid", "benefit_start_date", "benefit_end_date"))
    return both.select(
        F.col("entity").alias("snz_uid"), "kind", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "spells"
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_periods(spark, folder).where("kind = 'gap' or spells >= 2").drop("spells")


WIDE = wide.WideSpec(
    keys=("identity_column", "label_identity"),
    label="label_measure",
    value="value_measure",
    version="loaded_at",
    carry=("summary_period_start_date", "summary_period_end_date", "label_summary_period"),
    known=("identity_column",),
)


def _ids(spark: SparkSession, folder: str) -> list[tuple[int, str, str]]:
    return wide.label_ids(table(spark, folder, "measure_reference"), "label_measure", "value_type")


#: Ends of the loads of p5_found and p5_runs.
LOADS = ("2020-09-01", "2021-05-01", "2022-01-01", "2022-09-01")


def _runs(spark: SparkSession, folder: str, ids: list[tuple[int, str, str]]) -> DataFrame:
    """Stored runs: the table in five loads, each a run of sparse deltas, four of them merged."""
    rows, runs = table(spark, folder, "output_long_thin"), new_scratch(spark, "runs")
    at = F.coalesce(F.col("loaded_at"), F.lit(LOADS[0]).cast("timestamp_ntz"))
    ends = [F.lit(x).cast("timestamp_ntz") for x in LOADS]
    for i in range(len(LOADS) + 1):
        load = rows.where((at >= ends[i - 1] if i else F.lit(True)) & (at < ends[i] if i < len(ends) else F.lit(True)))
        wide_ingest.append_batch(load, i, runs, WIDE, ids, partitions_for(rows))
    wide_ingest.compact(spark, runs, WIDE)
    found = wide_ingest.read_runs(spark, runs, WIDE)
    return wide.sparse_deltas(rows.limit(0), WIDE, ids) if found is None else found


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    ids = _ids(spark, folder)
    run = wide.compact_runs(_runs(spark, folder, ids), WIDE)
    return wide.unclear_cells(run.select("*", F.explode("cells").alias("label_id", "cell")), WIDE, ids)


def p5_wide(spark: SparkSession, folder: str) -> DataFrame:
    ids = _ids(spark, folder)
    return wide.wide_of_cells(wide.cell_states(table(spark, folder, "output_long_thin"), WIDE, ids), WIDE, ids)


def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of p5_wide from stored runs."""
    ids = _ids(spark, folder)
    return wide.wide_rows(_runs(spark, folder, ids), WIDE, ids)


QUERIES = {f.__name__: f for f in (p2_found, p2_features, p2_store, p2_odd_amounts, p3_found, p3_periods, p5_found, p5_wide, p5_runs)}

_CELLS = f"""
WITH l AS (SELECT label_measure AS label, value_type AS kind, {fold_sql('label_measure')} AS k FROM measure_reference),
v AS (
  SELECT o.identity_column, o.label_identity, l.label, l.kind, o.loaded_at,
         CASE WHEN NOT isnan(o.value_measure) THEN o.value_measure END AS x
  FROM output_long_thin o JOIN l ON {fold_sql('o.label_measure')} = l.k
  WHERE o.identity_column IS NOT NULL
),
c AS (
  SELECT identity_column, label_identity, label, max(x) AS hi, min(x) AS lo,
         last(x ORDER BY loaded_at NULLS FIRST, x) AS val,
         bool_or(CASE kind WHEN 'flag' THEN x NOT IN (0, 1) WHEN 'whole' THEN x < 0 OR isinf(x) OR x <> floor(x) ELSE false END) AS bad
  FROM v WHERE x IS NOT NULL GROUP BY ALL
),
u AS (SELECT *, (coalesce(bad, false) OR (hi <> lo AND hi - lo > 0.01 + 1e-9)) AS unclear FROM c)
"""

_SPELLS = """
WITH s AS (
  SELECT DISTINCT snz_uid, benefit_start_date AS a, coalesce(benefit_end_date, DATE '9999-12-31') AS b
  FROM data_benefit_payment WHERE snz_uid IS NOT NULL AND benefit_start_date IS NOT NULL
    AND coalesce(benefit_end_date, DATE '9999-12-31') >= benefit_start_date
),
m AS (SELECT *, max(b) OVER (PARTITION BY snz_uid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR date_diff('day', reach, a) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY snz_uid ORDER BY a, b) AS no FROM m),
p AS (SELECT snz_uid, no, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY ALL),
g AS (SELECT snz_uid, b, lead(a) OVER (PARTITION BY snz_uid ORDER BY a) AS nxt FROM p)
"""


def _features_sql() -> str:
    cols = ", ".join(
        f"coalesce(count(*) FILTER (WHERE cause_id = {i}), 0) AS c{i}_n, max(accident_date) FILTER (WHERE cause_id = {i}) AS c{i}_last" for i in range(1, 301)
    )
    out = ", ".join(f"coalesce(c{i}_n, 0) AS c{i}_n, c{i}_last" for i in range(1, 301))
    return f"""
WITH a AS (SELECT d.snz_uid, d.accident_date, c.cause_id FROM data_accidents d
  LEFT JOIN cause_reference c ON {fold_sql('d.accident_cause')} = {fold_sql('c.accident_cause')} WHERE d.snz_uid IS NOT NULL),
w AS (SELECT snz_uid, count(*) FILTER (WHERE cause_id IS NULL) AS other_n, {cols} FROM a GROUP BY snz_uid),
p AS (SELECT snz_uid, count(*) AS payments_n, sum(payments) AS payments_total FROM
  (SELECT DISTINCT snz_uid, benefit_start_date, benefit_end_date, payments FROM data_benefit_payment) WHERE snz_uid IS NOT NULL GROUP BY 1)
SELECT coalesce(w.snz_uid, p.snz_uid) AS snz_uid, coalesce(other_n, 0) AS other_n, coalesce(payments_n, 0) AS payments_n, payments_total, {out}
FROM w FULL JOIN p ON w.snz_uid = p.snz_uid"""


SQL = {
    "p2_found": f"""
WITH a AS (SELECT d.snz_uid, c.cause_id, count(DISTINCT d.accident_date) AS days, max(d.accident_date) AS last_day
  FROM data_accidents d JOIN cause_reference c ON {fold_sql('d.accident_cause')} = {fold_sql('c.accident_cause')}
  WHERE d.accident_date BETWEEN DATE '2000-01-01' AND DATE '2019-12-31' GROUP BY ALL),
p AS (SELECT snz_uid, sum(payments) AS total FROM
  (SELECT DISTINCT snz_uid, benefit_start_date, benefit_end_date, payments FROM data_benefit_payment) GROUP BY ALL)
SELECT a.snz_uid, a.cause_id FROM a JOIN p ON a.snz_uid = p.snz_uid
WHERE days >= 3 AND last_day >= DATE '2019-01-01' AND total >= 1000""",
    "p2_features": _features_sql(),
    "p2_store": _features_sql(),
    "p2_odd_amounts": f"""
SELECT snz_uid, count(*) AS n, count(DISTINCT benefit_start_date) AS days, max(benefit_start_date) AS last_day,
  CASE WHEN NOT bool_or(coalesce(payments, 1) = 0) THEN sum(payments) END AS total
FROM data_benefit_payment WHERE snz_uid IS NOT NULL AND benefit_start_date BETWEEN DATE '{YEARS[0]}' AND DATE '{YEARS[1]}' GROUP BY 1""",
    "p3_found": _SPELLS
    + """
SELECT snz_uid, 'period' AS kind, a::VARCHAR AS first_day, b::VARCHAR AS last_day FROM p WHERE n >= 2
UNION ALL SELECT snz_uid, 'gap', (b + 1)::VARCHAR, (nxt - 1)::VARCHAR FROM g WHERE nxt IS NOT NULL""",
    "p3_periods": _SPELLS
    + """
SELECT snz_uid, 'period' AS kind, a::VARCHAR AS first_day, b::VARCHAR AS last_day, n AS spells FROM p
UNION ALL SELECT snz_uid, 'gap', (b + 1)::VARCHAR, (nxt - 1)::VARCHAR, 0 FROM g WHERE nxt IS NOT NULL""",
    "p5_found": _CELLS + "SELECT identity_column, label_identity, label AS label_measure FROM u WHERE unclear",
}


def wide_sql(reference: list[tuple[int, str, str]]) -> str:
    """SQL of p5_wide for the attributes of a reference table."""
    kinds = {"flag": "INTEGER", "whole": "BIGINT", "real": "DOUBLE"}
    q = lambda s: s.replace("'", "''")
    cols = ", ".join(
        f"""CAST(max(u.val) FILTER (WHERE u.label = '{q(n)}' AND NOT u.unclear) AS {kinds.get(k, 'DOUBLE')}) AS "{n.replace('"', '""')}\"""" for _, n, k in reference
    )
    return (
        _CELLS
        + f""",
r AS (SELECT identity_column, label_identity, max(summary_period_start_date) AS summary_period_start_date,
  max(summary_period_end_date) AS summary_period_end_date, max(label_summary_period) AS label_summary_period,
  count(*) FILTER (WHERE l.k IS NULL) AS unlisted
  FROM output_long_thin o LEFT JOIN l ON {fold_sql('o.label_measure')} = l.k WHERE identity_column IS NOT NULL GROUP BY 1, 2)
SELECT r.identity_column, r.label_identity, any_value(r.summary_period_start_date) AS summary_period_start_date,
  any_value(r.summary_period_end_date) AS summary_period_end_date, any_value(r.label_summary_period) AS label_summary_period,
  {cols}, coalesce(list_sort(list(u.label) FILTER (WHERE u.unclear)), []) AS unclear, any_value(r.unlisted) AS unlisted
FROM r LEFT JOIN u ON r.identity_column = u.identity_column AND r.label_identity IS NOT DISTINCT FROM u.label_identity
GROUP BY r.identity_column, r.label_identity"""
    )
