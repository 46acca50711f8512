"""Queries of the cohort operators: assembly, reshaping, checks, summaries and release, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import not_in
from tallyloom.operators import checks, confidential, disclosure, profile, reshape, summarise
from tallyloom.plans import control
from tallyloom.plans.assemble import long_thin, rectangular
from tallyloom.queries.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def one_row(spark: SparkSession, **values: object) -> DataFrame:
    names = list(values)
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {kinds[type(values[n])]}" for n in names))


# Assembly

PEOPLE, ACCIDENTS, BENEFITS = "data_project_population", "data_accidents", "data_benefit_payment"


def _population(label: str, start: str, end: str, period: str) -> dict[str, str]:
    where = dict.fromkeys(control.LOCATION, "[]") | {"table_name": f"[{PEOPLE}]"}
    return where | {
        "identity_column": "[snz_uid]",
        "label_identity": f'"{label}"',
        "summary_period_start_date": start,
        "summary_period_end_date": end,
        "label_summary_period": period,
    }


def _measure(name: str, label: str, value: str, summary: str, prop: bool = False) -> dict[str, str]:
    span = ("accident_date", "accident_date") if name == ACCIDENTS else ("benefit_start_date", "benefit_end_date")
    return dict.fromkeys(control.LOCATION, "[]") | {
        "table_name": f"[{name}]",
        "identity_column": "[snz_uid]",
        "measure_period_start_date": f"[{span[0]}]",
        "measure_period_end_date": f"[{span[1]}]",
        "label_measure": label,
        "value_measure": value,
        "measure_summarised_by": summary,
        "proportional": str(prop).upper(),
    }


POPULATIONS = [
    _population("lead_in", "[registration_date]", "[appointment_date]", "[appointment_type]"),
    _population("decade", '"2008-07-01"', '"2018-06-30"', '"ten years to mid 2018"'),
]
MEASURES = {
    "num_accidents": _measure(ACCIDENTS, '"acc_days"', "[accident_date]", "COUNT"),
    "num_causes": _measure(ACCIDENTS, '"acc_with_cause"', "[accident_cause]", "COUNT"),
    "histogram": _measure(ACCIDENTS, '"by"', "[accident_cause]", "HISTOGRAM"),
    "column_label": _measure(ACCIDENTS, "[accident_cause]", "[snz_uid]", "COUNT"),
    "any_accident": _measure(ACCIDENTS, '"acc_seen"', "[accident_cause]", "EXISTS"),
    "sum": _measure(BENEFITS, '"paid"', "[payments]", "SUM"),
    "sum_prop": _measure(BENEFITS, '"paid_share"', "[payments]", "SUM", True),
    "max": _measure(BENEFITS, '"paid_most"', "[payments]", "MAX"),
    "min": _measure(BENEFITS, '"paid_least"', "[payments]", "MIN"),
    "max_prop": _measure(BENEFITS, '"paid_most_share"', "[payments]", "MAX", True),
    "min_prop": _measure(BENEFITS, '"paid_least_share"', "[payments]", "MIN", True),
    "duration": _measure(BENEFITS, '"spell_days"', "[payments]", "DURATION"),
    "duration_prop": _measure(BENEFITS, '"spell_days_share"', "[payments]", "DURATION", True),
    "mean": _measure(BENEFITS, '"paid_mean"', "[payments]", "MEAN"),
    "mean_prop": _measure(BENEFITS, '"paid_mean_share"', "[payments]", "MEAN", True),
    "distinct": _measure(BENEFITS, '"amounts"', "[payments]", "DISTINCT"),
}
FLAT = [m for m in MEASURES if m not in ("histogram", "column_label")]


def assembled(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    ps = [(p, table(spark, folder, PEOPLE)) for p in control.population_rows(POPULATIONS)]
    ms = [(m, table(spark, folder, m.table.strip("`"))) for m in control.measure_rows([MEASURES[n] for n in names])]
    return long_thin(ps, ms)


def _text(cell: str, alias: str) -> str:
    inner = cell[1:-1]
    return f"{alias}.{inner}" if cell[0] == "[" else f"'{inner}'"


def _pair_sql(p: dict[str, str], m: dict[str, str]) -> str:
    ps, pe, pl = _text(p["summary_period_start_date"], "p"), _text(p["summary_period_end_date"], "p"), _text(p["label_summary_period"], "p")
    ms, me = _text(m["measure_period_start_date"], "m"), _text(m["measure_period_end_date"], "m")
    ps, pe = f"CAST({ps} AS DATE)", f"CAST({pe} AS DATE)"
    label, value, how = _text(m["label_measure"], "m"), _text(m["value_measure"], "m"), m["measure_summarised_by"]
    within = f"(1 + date_diff('day', greatest({ms}, {ps}), least({me}, {pe})))"
    whole = f"(1 + date_diff('day', {ms}, {me}))"
    v = f"CAST({value} AS DOUBLE)" + (f" * (CAST({within} AS DOUBLE) / nullif({whole}, 0))" if m["proportional"] == "TRUE" else "") if how in control.NUMERIC else value
    agg = {
        "MIN": f"min({v})",
        "MAX": f"max({v})",
        "SUM": f"sum({v})",
        "MEAN": f"avg({v})",
        "COUNT": f"count({v})",
        "HISTOGRAM": f"count({v})",
        "DISTINCT": f"count(DISTINCT {v})",
        "EXISTS": f"CASE WHEN count({v}) >= 1 THEN 1 ELSE 0 END",
        "DURATION": f"sum({within if m['proportional'] == 'TRUE' else whole})",
    }[how]
    if how == "HISTOGRAM":
        label = f"{label} || '=' || {value}"
    return f"""SELECT p.snz_uid AS identity_column, {_text(p['label_identity'], 'p')} AS label_identity, {ps} AS summary_period_start_date,
  {pe} AS summary_period_end_date, {pl} AS label_summary_period, {label} AS label_measure, CAST({agg} AS DOUBLE) AS value_measure
FROM {p['table_name'][1:-1]} p JOIN {m['table_name'][1:-1]} m ON p.snz_uid = m.snz_uid AND {ps} <= {me} AND {ms} <= {pe}
WHERE {label} IS NOT NULL GROUP BY ALL"""


def _raw_sql(names: list[str]) -> str:
    return "\nUNION ALL\n".join(_pair_sql(p, MEASURES[n]) for p in POPULATIONS for n in names)


def _long_sql(names: list[str]) -> str:
    return f"SELECT * REPLACE (round(value_measure, 4) AS value_measure) FROM ({_raw_sql(names)})"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value_measure", F.round("value_measure", 4))


for _n in MEASURES:
    QUERIES[f"asm_{_n}"] = lambda spark, folder, n=_n: _rounded(assembled(spark, folder, [n]))
    SQL[f"asm_{_n}"] = _long_sql([_n])


@query(_long_sql(list(MEASURES)))
def asm_long_thin(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(assembled(spark, folder, list(MEASURES)))


_LABELS = sorted(MEASURES[m]["label_measure"].strip('"') for m in FLAT)


@query(
    f"""WITH l AS ({_raw_sql(FLAT)})
SELECT identity_column, label_identity, summary_period_start_date, summary_period_end_date, label_summary_period, """
    + ", ".join(f"round(sum(CASE WHEN label_measure = '{x}' THEN value_measure ELSE 0 END), 4) AS {x}" for x in _LABELS)
    + " FROM l GROUP BY ALL"
)
def asm_rectangular(spark: SparkSession, folder: str) -> DataFrame:
    wide = rectangular(assembled(spark, folder, FLAT), _LABELS)
    return wide.select(*wide.columns[:5], *[F.round(c, 4).alias(c) for c in wide.columns[5:]])


# Reshaping


@query(
    """SELECT user_id, """
    + ", ".join(f"sum(CASE WHEN event_type = '{x}' THEN n ELSE 0 END)::BIGINT AS \"{x}\"" for x in ("click", "error", "purchase", "signup", "view"))
    + " FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id"
)
def pivot_events(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return reshape.pivot_table(counts, "event_type", "n", labels=["click", "error", "purchase", "signup", "view"])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'filled' WHEN o_totalprice > 200000 THEN 'large'
  WHEN o_orderpriority LIKE '1%' THEN 'urgent' END AS kind FROM orders"""
)
def collapse_indicators(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_orderpriority").startswith("1")).cast("int").alias("is_urgent"),
        (F.col("o_totalprice") > 200000).cast("int").alias("is_large"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_filled"),
    )
    return reshape.collapse_indicator_columns(o, "is_", [1], "kind")


@query("SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all_accounts(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"), "c_name")
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return reshape.union_all(c, s, ["nationkey", "acctbal"])


@query(
    """SELECT n_name AS name, n_regionkey AS regionkey, NULL::DOUBLE AS acctbal FROM nation
UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier"""
)
def bind_rows(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"))
    s = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return reshape.bind_rows(n, s)


@query("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de')")
def filter_not_in(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(not_in(F.col("lang"), ["en", "de"])).select("doc_id", "lang")


@query(
    """SELECT coalesce(a.snz_uid, b.snz_uid) AS snz_uid, accidents, payments FROM
(SELECT snz_uid, count(*) AS accidents FROM data_accidents WHERE snz_uid IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT snz_uid, count(*) AS payments FROM data_benefit_payment WHERE snz_uid IS NOT NULL GROUP BY 1) b ON a.snz_uid = b.snz_uid"""
)
def full_join_persons(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (table(spark, folder, t).where("snz_uid is not null").groupBy("snz_uid").agg(F.count(F.lit(1)).alias(n)) for t, n in ((ACCIDENTS, "accidents"), (BENEFITS, "payments")))
    return a.join(b, "snz_uid", "full_outer")


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'middle' END AS size_band,
  date_trunc('month', o_orderdate)::DATE AS month, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS age FROM orders"""
)
def categorised_orders(spark: SparkSession, folder: str) -> DataFrame:
    price, day = F.col("o_totalprice"), F.col("o_orderdate").cast("date")
    band = F.when(price < 50000, "small").when(price < 200000, "middle")
    return table(spark, folder, "orders").select(
        "o_orderkey", band.alias("size_band"), F.trunc(day, "month").alias("month"), F.datediff(F.lit("2002-01-01").cast("date"), day).cast("bigint").alias("age")
    )


# Checks


@query(
    """SELECT (SELECT count(*) FROM orders)::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders))::BIGINT AS n_distinct,
  (SELECT sum((accident_cause IS NULL)::INT + (accident_date IS NULL)::INT + (snz_uid IS NULL)::INT) FROM data_accidents)::BIGINT AS n_missing,
  (SELECT count(*) > 100 FROM orders) AS size_ok, (SELECT count(*) FROM lineitem) > (SELECT count(*) FROM orders) AS larger,
  (SELECT count(DISTINCT event_type) = 5 FROM events) AS types_ok, (SELECT count(*) = 0 FROM data_accidents WHERE snz_uid IS NULL) AS complete"""
)
def chk_sizes(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines, events, accidents = (table(spark, folder, t) for t in ("orders", "lineitem", "events", ACCIDENTS))
    return one_row(
        spark,
        n_rows=checks.num_row(orders),
        n_distinct=checks.num_unique_entries(orders, ["o_orderstatus", "o_orderpriority"]),
        n_missing=checks.num_missing_entries(accidents, ["accident_cause", "accident_date", "snz_uid"]),
        size_ok=checks.check_size(orders, ">", 100),
        larger=checks.check_size_comparison(lines, ">", orders),
        types_ok=checks.check_num_distinct(events, "event_type", "==", 5),
        complete=checks.check_size_missing(accidents, "snz_uid", "==", 0),
    )


@query(
    """SELECT (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS orders_unique,
  NOT EXISTS (SELECT 1 FROM data_project_population GROUP BY snz_uid HAVING count(*) > 1) AS people_unique"""
)
def chk_unique(spark: SparkSession, folder: str) -> DataFrame:
    return one_row(
        spark,
        orders_unique=checks.check_all_unique(table(spark, folder, "orders"), "o_orderkey"),
        people_unique=checks.check_all_unique(table(spark, folder, PEOPLE), "snz_uid"),
    )


@query("SELECT a.* FROM data_accidents a WHERE NOT EXISTS (SELECT 1 FROM data_project_population p WHERE p.snz_uid = a.snz_uid)")
def chk_uncovered(spark: SparkSession, folder: str) -> DataFrame:
    return checks.uncovered(table(spark, folder, ACCIDENTS), table(spark, folder, PEOPLE), "snz_uid")


@query(
    """SELECT NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orders_covered,
  NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS customers_covered"""
)
def chk_join_covered(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    return one_row(
        spark,
        orders_covered=checks.check_join_covered(orders, customers, {"o_custkey": "c_custkey"}),
        customers_covered=checks.check_join_covered(customers, orders, {"c_custkey": "o_custkey"}),
    )


@query(
    """WITH s AS (SELECT snz_uid AS g, benefit_start_date AS s, benefit_end_date AS e, row_number() OVER () AS i FROM data_benefit_payment),
o AS (SELECT o_orderkey AS g, min(l_shipdate)::DATE AS s, max(l_shipdate)::DATE AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT NOT (EXISTS (SELECT 1 FROM s GROUP BY g, s HAVING count(*) > 1) OR EXISTS (SELECT 1 FROM s GROUP BY g, e HAVING count(*) > 1)
  OR EXISTS (SELECT 1 FROM s a JOIN s b ON a.g = b.g AND a.s <= b.e AND b.s <= a.e AND a.s <> b.s AND a.e <> b.e)) AS benefits_apart,
  NOT (EXISTS (SELECT 1 FROM o GROUP BY g, s HAVING count(*) > 1) OR EXISTS (SELECT 1 FROM o GROUP BY g, e HAVING count(*) > 1)) AS orders_apart"""
)
def chk_date_overlap(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("s"), F.max("l_shipdate").cast("date").alias("e"))
    return one_row(
        spark,
        benefits_apart=checks.check_no_date_overlap(table(spark, folder, BENEFITS), "benefit_start_date", "benefit_end_date", "snz_uid"),
        orders_apart=checks.check_no_date_overlap(lines, "s", "e", "l_orderkey"),
    )


@query(
    """WITH s AS (SELECT snz_uid, benefit_start_date AS s, benefit_end_date AS e FROM data_benefit_payment)
SELECT snz_uid, 'equal start' AS clash FROM s GROUP BY snz_uid, s HAVING count(*) > 1
UNION SELECT snz_uid, 'equal end' FROM s GROUP BY snz_uid, e HAVING count(*) > 1
UNION SELECT a.snz_uid, 'overlap' FROM s a JOIN s b ON a.snz_uid = b.snz_uid AND a.s <= b.e AND b.s <= a.e AND a.s <> b.s"""
)
def chk_clashing_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The whole sweep decides here: overlaps and inverted spells of every person."""
    return checks.clashing_groups(table(spark, folder, BENEFITS), "benefit_start_date", "benefit_end_date", "snz_uid")


@query("SELECT * FROM orders WHERE o_orderkey % (SELECT CAST(ceil(count(*) / 500.0) AS BIGINT) FROM orders) = 0 ORDER BY o_orderkey LIMIT 500")
def sample_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The limit is the operator's own."""
    return profile.limited_rows(table(spark, folder, "orders").orderBy("o_orderkey"), 500, "o_orderkey")


@query(
    """SELECT 'accident_cause' AS name, count(*) - count(accident_cause) AS missing, min(accident_cause) AS low, max(accident_cause) AS high FROM data_accidents
UNION ALL SELECT 'accident_date', count(*) - count(accident_date), min(accident_date)::VARCHAR, max(accident_date)::VARCHAR FROM data_accidents
UNION ALL SELECT 'snz_uid', count(*) - count(snz_uid), min(snz_uid)::VARCHAR, max(snz_uid)::VARCHAR FROM data_accidents"""
)
def profile_accidents(spark: SparkSession, folder: str) -> DataFrame:
    rows = profile.profile_columns(table(spark, folder, ACCIDENTS).select("snz_uid", "accident_date", "accident_cause"))
    return spark.createDataFrame([(r["column"], r["missing"], r["min"], r["max"]) for r in rows], "name string, missing bigint, low string, high string")


def _profile_sql(column: str, number: bool) -> str:
    top = f"""(SELECT string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) FROM (SELECT {column}::VARCHAR AS v, count(*) AS n FROM data_accidents
  WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"""
    return f"""SELECT '{column}' AS name, count(*) AS "rows", count(*) - count({column}) AS missing, count(DISTINCT {column}) AS "distinct",
  min({column})::VARCHAR AS low, max({column})::VARCHAR AS high, {f'avg({column})' if number else 'NULL::DOUBLE'} AS mean, {top} AS top FROM data_accidents"""


@query("\nUNION ALL\n".join(_profile_sql(c, c == "snz_uid") for c in ("snz_uid", "accident_date", "accident_cause")))
def profile_accidents_whole(spark: SparkSession, folder: str) -> DataFrame:
    """All figures of the report."""
    rows = profile.profile_columns(table(spark, folder, ACCIDENTS).select("snz_uid", "accident_date", "accident_cause"))
    cells = [(r["column"], r["rows"], r["missing"], r["distinct"], r["min"], r["max"], r["mean"], ", ".join(f"{v} ({n})" for v, n in r["top"])) for r in rows]
    return spark.createDataFrame(cells, "name string, rows bigint, missing bigint, distinct bigint, low string, high string, mean double, top string")


# Summaries

ORDER_GROUPS = [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]]


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))


@query(
    """SELECT 'o_orderstatus' AS col01, o_orderstatus AS val01, 'cents' AS summarised_var, count(DISTINCT c) AS "distinct", count(*) AS "count", sum(c)::BIGINT AS "sum"
FROM (SELECT o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) WHERE o_orderstatus IS NOT NULL AND c IS NOT NULL GROUP BY ALL"""
)
def summarise_one(spark: SparkSession, folder: str) -> DataFrame:
    return summarise.summarise_and_label(_orders(spark, folder), ["o_orderstatus"], "cents", True, True, True)


def _summary_sql(source: str, groups: list[list[str]], cols: list[str], what: dict[str, str], remove: bool = True, clean: str = "{c}") -> str:
    width, parts = max(map(len, groups)), []
    for c in cols:
        x = clean.format(c=c)
        for g in groups:
            labels = [f"'{n}' AS col{i:02d}, CAST({n} AS VARCHAR) AS val{i:02d}" for i, n in enumerate(g, 1)]
            labels += [f"CAST(NULL AS VARCHAR) AS col{i:02d}, CAST(NULL AS VARCHAR) AS val{i:02d}" for i in range(len(g) + 1, width + 1)]
            keep = "".join(f" AND {n} IS NOT NULL" for n in g) if remove else ""
            measures = ", ".join(f'CAST({e.format(x=x)} AS BIGINT) AS "{k}"' for k, e in what.items())
            parts.append(f"SELECT {', '.join(labels)}, '{c}' AS summarised_var, {measures} FROM {source} WHERE {x} IS NOT NULL{keep} GROUP BY {', '.join(g)}")
    return "\nUNION ALL\n".join(parts)


ALL = {"distinct": "count(DISTINCT {x})", "count": "count({x})", "sum": "sum({x})"}
_CENTS = "(SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"
DOC_GROUPS = [["lang"], ["source"], ["lang", "source"]]


@query(_summary_sql(_CENTS, ORDER_GROUPS, ["cents", "o_custkey"], ALL))
def summarise_lists(spark: SparkSession, folder: str) -> DataFrame:
    return summarise.summarise_and_label_over_lists(_orders(spark, folder), ORDER_GROUPS, ["cents", "o_custkey"], True, True, True)


@query(_summary_sql("documents", DOC_GROUPS, ["n_chars", "lines_added"], ALL, False))
def summarise_with_missing_groups(spark: SparkSession, folder: str) -> DataFrame:
    return summarise.summarise_and_label_over_lists(table(spark, folder, "documents"), DOC_GROUPS, ["n_chars", "lines_added"], True, True, True, remove_na_from_groups=False)


@query(_summary_sql("documents", DOC_GROUPS, ["lines_removed"], ALL, True, "nullif({c}, 0)"))
def summarise_zero_as_na(spark: SparkSession, folder: str) -> DataFrame:
    return summarise.summarise_and_label_over_lists(table(spark, folder, "documents"), DOC_GROUPS, ["lines_removed"], True, True, True, "zero.as.na")


@query(_summary_sql("documents", DOC_GROUPS, ["lines_removed"], ALL, True, "coalesce({c}, 0)"))
def summarise_na_as_zero(spark: SparkSession, folder: str) -> DataFrame:
    return summarise.summarise_and_label_over_lists(table(spark, folder, "documents"), DOC_GROUPS, ["lines_removed"], True, True, True, "na.as.zero")


# Release


def _documents_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summarise.summarise_and_label_over_lists(table(spark, folder, "documents"), DOC_GROUPS, ["n_chars"], True, True, True)


_SUMMARY = _summary_sql("documents", DOC_GROUPS, ["n_chars"], ALL)
_LABEL_COLS = ["col01", "val01", "col02", "val02", "summarised_var"]
_U = f"""(('0x' || substr(md5(array_to_string(list_sort(list_filter([{', '.join(_LABEL_COLS)}], lambda t: t IS NOT NULL)), ' ')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"""
_ROUND = "CASE WHEN {x} % {b} = 0 THEN {x} ELSE {x} - {x} % {b} + CASE WHEN u < ({b} - {x} % {b})::DOUBLE / {b} THEN 0 ELSE {b} END END"
_GRADE = "(CASE WHEN abs({x}) < 19 THEN 3 WHEN abs({x}) < 20 THEN 2 WHEN abs({x}) < 100 THEN 5 WHEN abs({x}) < 1000 THEN 10 ELSE 100 END)"
_BASE = f"s AS ({_SUMMARY}), w AS (SELECT *, {_U} AS u FROM s)"
_NAMES = ", ".join(_LABEL_COLS)


@query(f"""WITH {_BASE} SELECT {_NAMES}, "sum", "distinct" AS raw_distinct, "count" AS raw_count,
{_ROUND.format(x='"distinct"', b=3)} AS conf_distinct, {_ROUND.format(x='"count"', b=3)} AS conf_count FROM w""")
def round_stable(spark: SparkSession, folder: str) -> DataFrame:
    return confidential.apply_random_rounding(_documents_summary(spark, folder), ["distinct", "count"], 3, _LABEL_COLS)


@query(f"""WITH {_BASE} SELECT {_NAMES}, "sum", "distinct", "count" AS raw_count, {_ROUND.format(x='"count"', b=_GRADE.format(x='"count"'))} AS conf_count FROM w""")
def round_graduated(spark: SparkSession, folder: str) -> DataFrame:
    return confidential.apply_graduated_random_rounding(_documents_summary(spark, folder), ["count"], _LABEL_COLS)


@query()
def round_unseeded(spark: SparkSession, folder: str) -> DataFrame:
    return confidential.apply_random_rounding(_documents_summary(spark, folder), ["distinct", "count"])


@query(f"""WITH {_BASE} SELECT {_NAMES}, CASE WHEN NOT ("count" < 6 OR "distinct" < 5) THEN "distinct" END AS "distinct",
CASE WHEN NOT ("count" < 6 OR "distinct" < 5) THEN "count" END AS "count", "sum" FROM w""")
def suppress_small(spark: SparkSession, folder: str) -> DataFrame:
    return confidential.apply_small_count_suppression(_documents_summary(spark, folder), ["distinct", "count"], [5, 6])


_CONF = f"""{_BASE}, r AS (SELECT {_NAMES}, "distinct" AS raw_distinct, "count" AS raw_count, "sum" AS raw_sum,
  CASE WHEN NOT ("distinct" < 6 OR "count" < 6) THEN {_ROUND.format(x='"distinct"', b=3)} END AS cd,
  CASE WHEN NOT ("distinct" < 6 OR "count" < 6) THEN {_ROUND.format(x='"count"', b=3)} END AS cc,
  CASE WHEN NOT ("distinct" < 20 OR "count" < 20) THEN "sum" END AS conf_sum FROM w),
c AS (SELECT {_NAMES}, raw_distinct, raw_count, raw_sum, conf_sum,
  CASE WHEN raw_distinct < 20 AND cd >= 20 THEN cd - 3 WHEN raw_distinct >= 20 AND cd < 20 THEN cd + 3 ELSE cd END AS conf_distinct,
  CASE WHEN raw_count < 20 AND cc >= 20 THEN cc - 3 WHEN raw_count >= 20 AND cc < 20 THEN cc + 3 ELSE cc END AS conf_count FROM r)"""


@query(f"WITH {_CONF} SELECT * FROM c")
def confidentialised(spark: SparkSession, folder: str) -> DataFrame:
    return confidential.confidentialise_results(_documents_summary(spark, folder), stable_rr=True)


_SAME = " AND ".join(f"g.{c} IS NOT DISTINCT FROM c.{c}" for c in _LABEL_COLS)


@query(
    f"""WITH {_CONF}, k AS (SELECT DISTINCT col01, col02, summarised_var FROM c),
v1 AS (SELECT DISTINCT col01, col02, summarised_var, val01 FROM c), v2 AS (SELECT DISTINCT col01, col02, summarised_var, val02 FROM c),
g AS (SELECT k.col01, v1.val01, k.col02, v2.val02, k.summarised_var FROM k
  JOIN v1 ON k.col01 = v1.col01 AND k.col02 IS NOT DISTINCT FROM v1.col02 JOIN v2 ON k.col01 = v2.col01 AND k.col02 IS NOT DISTINCT FROM v2.col02)
SELECT g.*, raw_distinct, raw_count, raw_sum, conf_sum, conf_distinct, conf_count FROM g LEFT JOIN c ON {_SAME}"""
)
def expanded_zero_counts(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.expand_to_include_zero_counts(confidentialised(spark, folder))


@query(
    f"""WITH {_CONF} SELECT bool_and(coalesce(conf_count % 3 = 0, true)) AS multiples, bool_and(coalesce(conf_count % {_GRADE.format(x='conf_count')} = 0, true)) AS graded,
NOT bool_or((coalesce(raw_count < 6, true)) AND conf_count IS NOT NULL) AS suppressed, NOT bool_or((coalesce(raw_count < 20, true)) AND conf_sum IS NOT NULL) AS sums_suppressed,
(SELECT bool_and(n = v1 * v2) FROM (SELECT count(*) AS n, count(DISTINCT coalesce(val01, '')) AS v1, count(DISTINCT coalesce(val02, '')) AS v2, bool_or(conf_count IS NULL) AS hidden
  FROM c GROUP BY col01, col02, summarised_var) WHERE hidden) AS no_zero_counts FROM c"""
)
def chk_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    df = confidentialised(spark, folder)
    return one_row(
        spark,
        multiples=disclosure.check_rounding_to_base_df(df, "conf_count"),
        graded=disclosure.check_graduated_rounding_df(df, "conf_count"),
        suppressed=disclosure.check_small_count_suppression(df, "conf_count", 6, "raw_count"),
        sums_suppressed=disclosure.check_small_count_suppression(df, "conf_sum", 20, "raw_count"),
        no_zero_counts=disclosure.check_absence_of_zero_counts(df, "conf_count"),
    )


@query(f"""WITH {_CONF}, k AS (SELECT conf_count - raw_count AS d FROM c) SELECT d AS difference, count(*) AS n FROM k WHERE d IS NOT NULL AND d <> 0 GROUP BY 1""")
def rounding_differences(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.rounding_differences(confidentialised(spark, folder), "raw_count", "conf_count")


@query()
def release_report(spark: SparkSession, folder: str) -> DataFrame:
    lines = disclosure.check_confidentialised_results(expanded_zero_counts(spark, folder))
    return spark.createDataFrame(list(enumerate(lines)), "no int, line string")
