"""Queries of what surrounds the cohort operators: control files, the catalog, asserts, names, files and reports, with their SQL."""

from __future__ import annotations

import io
import warnings
from collections.abc import Callable
from contextlib import redirect_stdout

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom import names
from tallyloom.functions import folded
from tallyloom.operators import checks, confidential, disclosure, profile, reshape, summarise
from tallyloom.plans import assemble, control
from tallyloom.queries import cohort
from tallyloom.queries.common import fold_sql, table
from tallyloom.session import new_scratch
from tallyloom.sources import catalog, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple], columns: str) -> str:
    """SQL of a few constant rows."""

    def text(v: object) -> str:
        if v is None:
            return "NULL"
        return str(v).lower() if isinstance(v, (bool, int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS t({columns})"


def _database(spark: SparkSession) -> str:
    """A database of this call alone, its tables in the shared folder."""
    folder = new_scratch(spark, "db")
    name = "tallyloom_" + folder.rsplit("-", 1)[-1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    return f"[{name}]"


# Control files


def _control_file(spark: SparkSession, rows: list[dict[str, str]], name: str) -> str:
    path = f"{new_scratch(spark, name)}.csv"
    files.write_results_csv(spark.createDataFrame(pd.DataFrame(rows)).coalesce(1), path)
    return path


def _control(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Control files of the flat measures, over views named as the control tables name them."""
    for t in (cohort.PEOPLE, cohort.ACCIDENTS, cohort.BENEFITS):
        table(spark, folder, t).createOrReplaceTempView(f"wf_{t}")
    at = lambda r: {k.upper(): v for k, v in r.items()} | {"TABLE_NAME": "[wf_" + r["table_name"][1:], "NOTES": "not read"}
    people = [at(r) for r in cohort.POPULATIONS]
    return _control_file(spark, people, "population"), _control_file(spark, [at(cohort.MEASURES[m]) for m in cohort.FLAT], "measures")


@query(cohort.SQL["asm_rectangular"])
def wf_control_files(spark: SparkSession, folder: str) -> DataFrame:
    """The whole assembly: files read and checked, long-thin and rectangular tables stored, labels found in what was stored."""
    schema = _database(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        _, wide = assemble.assemble(spark, *_control(spark, folder), output_schema=schema, output_long="[long]", output_rectangular="[wide]", silent=True)
    return wide.select(*wide.columns[:5], *[F.round(c, 4).alias(c) for c in wide.columns[5:]])


@query(
    f"""WITH l AS ({cohort._raw_sql(cohort.FLAT)})
SELECT label_measure, 2 * count(*) AS "rows", round(2 * sum(value_measure), 2) AS total FROM l GROUP BY 1"""
)
def wf_control_append(spark: SparkSession, folder: str) -> DataFrame:
    """An assembly appended to its own long-thin table: every row twice. Before it a run of the checks alone, which stores nothing."""
    schema, control_files = _database(spark), _control(spark, folder)
    for append in (None, False, True):
        assemble.assemble(spark, *control_files, output_schema=schema, output_long="[long]", silent=True, run_checks_only=append is None, append=bool(append))
        if append is None and catalog.table_or_view_exists(spark, "[]", schema, "[long]"):
            raise AssertionError("a run of the checks stored a table")
    long = catalog.access_table(spark, "[]", schema, "[long]")
    return long.groupBy("label_measure").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value_measure"), 2).alias("total"))


#: Cells planted in the control tables: name, table, column, value, and the number of faults they are.
FAULTS = [
    ("nothing", "m", "label_measure", '"fine"', 0),
    ("missing cell", "p", "label_identity", None, 1),
    ("blank cell", "m", "value_measure", "", 1),
    ("no delimiters", "p", "identity_column", "snz_uid", 1),
    ("literal for a table", "m", "table_name", '"wf_data_accidents"', 1),
    ("bracket inside", "m", "label_measure", "[a[b]", 1),
    ("quote inside", "p", "label_summary_period", '"it\'s"', 1),
    ("unknown summary", "m", "measure_summarised_by", "MEDIAN", 1),
    ("summary in lower case", "m", "measure_summarised_by", "exists", 0),
    ("unknown proportional", "m", "proportional", "perhaps", 1),
    ("short proportional", "m", "proportional", "t", 0),
    ("no such table", "m", "table_name", "[wf_nowhere]", 1),
    ("no such column", "p", "identity_column", "[wf_nobody]", 1),
    ("text to sum", "m", "measure_summarised_by", "SUM", 1),
    ("column taken out", "m", "label_measure", "out", 1),
]


@query(_values([(f[0], f[4]) for f in FAULTS], "planted, faults").replace("SELECT *", "SELECT planted, faults::BIGINT AS faults"))
def wf_faults(spark: SparkSession, folder: str) -> DataFrame:
    """How many faults the checks of control tables find for each planted cell."""
    for t in (cohort.PEOPLE, cohort.ACCIDENTS):
        table(spark, folder, t).createOrReplaceTempView(f"wf_{t}")
    out = []
    for planted, which, column, value, _ in FAULTS:
        people = [dict(cohort.POPULATIONS[0]) | {"table_name": f"[wf_{cohort.PEOPLE}]"}]
        measures = [dict(cohort.MEASURES["num_causes"]) | {"table_name": f"[wf_{cohort.ACCIDENTS}]"}]
        row = (people if which == "p" else measures)[0]
        if value == "out":
            del row[column]
        else:
            row[column] = value
        found = control.issues_of(people, "population", control.POPULATION) + control.issues_of(measures, "measures", control.MEASURES) + control.keyword_issues(measures)
        if not found:
            found = control.table_issues(spark, people, "population", control.POPULATION) + control.table_issues(spark, measures, "measures", control.MEASURES)
        out.append((planted, len(found)))
    return spark.createDataFrame(out, "planted string, faults bigint")


# Catalog


@query(
    f"""WITH p AS (SELECT * FROM {cohort.PEOPLE})
SELECT 'created' AS step, 0::BIGINT AS "rows", 0::BIGINT AS ids, 0::BIGINT AS kinds
UNION ALL SELECT 'appended', count(*), count(snz_uid), count(appointment_type) FROM p
UNION ALL SELECT 'appended again', 2 * count(*), 2 * count(snz_uid), count(appointment_type) FROM p
UNION ALL SELECT 'view', count(*), count(snz_uid), count(*) FROM p WHERE appointment_type IS NOT NULL
UNION ALL SELECT 'session view', count(*), count(snz_uid), 0 FROM p WHERE appointment_type IS NULL
UNION ALL SELECT 'overwritten', count(*), count(snz_uid), count(appointment_type) FROM (SELECT DISTINCT snz_uid, appointment_type FROM p)
UNION ALL SELECT 'clustered and compressed', count(*), count(snz_uid), count(appointment_type) FROM (SELECT DISTINCT snz_uid, appointment_type FROM p)
UNION ALL SELECT 'for reuse', count(*), count(*), count(*) FROM (SELECT snz_uid FROM p WHERE snz_uid IS NOT NULL GROUP BY 1)
UNION ALL SELECT 'copied', 3, 3, 3
UNION ALL SELECT 'refused', 3, 0, 0
UNION ALL SELECT 'dropped', 0, 0, 0"""
)
def cat_life(spark: SparkSession, folder: str) -> DataFrame:
    """A table's life: created, appended to by name, viewed, overwritten, clustered, compressed, reused, copied, refused, dropped."""
    people, out, at = table(spark, folder, cohort.PEOPLE), [], ("[]", _database(spark))
    who = people.select("snz_uid", F.col("appointment_type").alias("kind"), F.lit(1).alias("more"))

    def note(step: str, df: DataFrame) -> None:
        r = df.agg(F.count(F.lit(1)), F.count("snz_uid"), F.count("kind")).first()
        out.append((step, *map(int, r)))

    note("created", catalog.create_table(spark, {"snz_uid": "[bigint] NULL", "seen": "[date] NULL", "kind": "[varchar](400) NULL"}, *at, "[people]"))
    note("appended", catalog.append_to_table(who, ["kind", "snz_uid"], *at, "[people]"))
    note("appended again", catalog.append_to_table(who, ["snz_uid"], *at, "[people]"))
    name = names.catalog_name(*at, "[people]")
    note("view", catalog.create_view(f"SELECT * FROM {name} WHERE kind IS NOT NULL", "[kinds]", True, *at, spark=spark))
    note("session view", catalog.create_view(who.where("kind is null"), "wf_no_kind", True))
    note("overwritten", catalog.write_table(who.select("snz_uid", "kind").distinct(), *at, "[people]", overwrite=True))
    catalog.rewrite_clustered(spark, ["snz_uid"], *at, "[people]", buckets=3)
    stored = catalog.compress_table(spark, *at, "[people]", "gzip")
    kept = catalog.layout(spark, *at, "[people]")
    note("clustered and compressed" if kept == {"bucket_by": ["snz_uid"], "buckets": 3, "sort_by": ["snz_uid"], "codec": "gzip"} else str(kept), stored)
    note("for reuse", catalog.write_for_reuse(who.where("snz_uid is not null").groupBy("snz_uid").agg(F.max(F.lit("x")).alias("kind")), *at, "[ids]", ["snz_uid"]))
    note("copied", catalog.copy_local(spark, pd.DataFrame({"snz_uid": [1, 2, 3], "kind": ["a", "b", "c"]}), *at, "[local]"))
    refused = 0
    tries = (lambda: catalog.write_table(who, *at, "[people]"), lambda: catalog.access_table(spark, *at, "[nowhere]"), lambda: catalog.append_to_table(who, ["more"], *at, "[people]"))
    for attempt in tries:
        try:
            attempt()
        except ValueError:
            refused += 1
    out.append(("refused", refused, 0, 0))
    for t, mode in (("[kinds]", "view"), ("[people]", "table"), ("[ids]", "TABLE"), ("[local]", "table"), ("[never]", "table")):
        catalog.delete_table(spark, *at, t, mode)
    catalog.delete_table(spark, table="wf_no_kind", mode="view")
    left = sum(catalog.table_or_view_exists(spark, *at, t) for t in ("[kinds]", "[people]", "[ids]", "[local]"))
    out.append(("dropped", left, int(catalog.table_or_view_exists(spark, table="wf_no_kind")), 0))
    return spark.createDataFrame(out, "step string, rows bigint, ids bigint, kinds bigint")


@query("SELECT doc_id, lang, source, author FROM documents")
def cat_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A table written as csv and read back, all cells text; empty texts come back as NULL, so they are told apart by a mark."""
    docs = table(spark, folder, "documents").select("doc_id", *[F.concat(F.lit("="), c).alias(c) for c in ("lang", "source", "author")])
    path = f"{new_scratch(spark, 'results')}.csv"
    files.write_results_csv(docs, path)
    back = files.read_table_file(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.substring(c, 2, 1 << 30).alias(c) for c in ("lang", "source", "author")])


# Names, messages, asserts

_TEXTS = [("[a]", "[]"), ("a", "[]"), ("[a", "[]"), ("[a][b]", "[]"), ("[a[b]]", "[]"), ('"a"', '"'), ('"it\'s"', '"'), ("[it's]", "[]"), ("", "[]"), ('"', '"')]


@query(
    f"""WITH t AS ({_values(_TEXTS, "txt, d")}),
m AS (SELECT txt, d, left(d, 1) AS a, right(d, 1) AS b FROM t),
r AS (SELECT *, CASE WHEN starts_with(txt, a) THEN substr(txt, 2) ELSE txt END AS head FROM m),
i AS (SELECT *, CASE WHEN ends_with(head, b) THEN left(head, length(head) - 1) ELSE head END AS removed FROM r)
SELECT txt, d AS delimiter, length(txt) >= 2 AND starts_with(txt, a) AND ends_with(txt, b) AS delimited, removed, a || removed || b AS added,
  contains(removed, a) OR contains(removed, b) OR (d = '"' AND contains(removed, '''')) AS inside FROM i"""
)
def wf_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(t, d, names.is_delimited(t, d), names.remove_delimiters(t, d), names.add_delimiters(t, d), names.has_internal_delimiters(t, d)) for t, d in _TEXTS]
    return spark.createDataFrame(rows, "txt string, delimiter string, delimited boolean, removed string, added string, inside boolean")


_NAMES = [("[d]", "[s]"), ("", "[s]"), ("[d]", ""), ("d", "[s]"), ("", ""), ("[d;]", "[s]"), ("[]", "[s]")]


@query(
    _values(
        [("[d]", "[s]", "[d].[s]", 0), ("", "[s]", "[s]", 0), ("[d]", "", "[d]", 0), ("d", "[s]", "d.[s]", 1), ("", "", None, 0), ("[d;]", "[s]", None, 0), ("[]", "[s]", "[].[s]", 0)],
        "db, sch, name, warned",
    ).replace("SELECT *", "SELECT db, sch, name, warned::BIGINT AS warned")
)
def wf_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of database and schema, NULL where they are refused, and the warnings of missing brackets."""
    out = []
    for db, schema in _NAMES:
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            try:
                name = names.db_schema(db, schema)
            except ValueError:
                name = None
        out.append((db, schema, name, len(seen) if name else 0))
    return spark.createDataFrame(out, "db string, sch string, name string, warned bigint")


@query(
    _values([(None, " | go"), ("heading", " | GO"), ("details", " |  -- go"), ("all", " |  ---- go")], "context, form")
)
def wf_messages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(c, names.inform("go", c, True)[19:]) for c in (None, "heading", "details", "all")], "context string, form string")


@query(
    """WITH o AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS s FROM orders), l AS (SELECT count(*) AS n FROM lineitem),
a AS (SELECT count(*) AS n, count(*) - count(accident_cause) AS m FROM data_accidents),
p AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT snz_uid FROM data_project_population)) AS d FROM data_project_population),
r AS (SELECT 'size' AS name, true AS ok, n FROM o UNION ALL SELECT 'size wrong', false, NULL FROM o
UNION ALL SELECT 'comparison', l.n > o.n, CASE WHEN l.n > o.n THEN l.n END FROM l, o UNION ALL SELECT 'comparison wrong', l.n < o.n, NULL FROM l, o
UNION ALL SELECT 'distinct', true, s FROM o UNION ALL SELECT 'distinct wrong', false, NULL FROM o
UNION ALL SELECT 'unique', true, n FROM o UNION ALL SELECT 'unique wrong', n = d, CASE WHEN n = d THEN n END FROM p
UNION ALL SELECT 'missing', true, m FROM a UNION ALL SELECT 'missing wrong', false, NULL FROM a
UNION ALL SELECT 'covered', true, 0 UNION ALL SELECT 'covered wrong', NOT EXISTS (SELECT 1 FROM data_accidents x WHERE NOT EXISTS (SELECT 1 FROM data_project_population y WHERE x.snz_uid = y.snz_uid)), NULL)
SELECT name, ok, n::BIGINT AS n FROM r"""
)
def wf_asserts(spark: SparkSession, folder: str) -> DataFrame:
    """Each assert where it holds and where it should raise: whether it held, and the figure it gave."""
    orders, lines, customers, accidents, people = (table(spark, folder, t) for t in ("orders", "lineitem", "customer", cohort.ACCIDENTS, cohort.PEOPLE))
    tries = {
        "size": lambda: checks.assert_size(orders, ">", 0),
        "size wrong": lambda: checks.assert_size(orders, "<", 0),
        "comparison": lambda: checks.assert_size_comparison(lines, ">", orders)[0],
        "comparison wrong": lambda: checks.assert_size_comparison(lines, "<", orders)[0],
        "distinct": lambda: checks.assert_num_distinct(orders, "o_orderstatus", "<=", 100),
        "distinct wrong": lambda: checks.assert_num_distinct(orders, ["o_orderstatus"], ">", 100),
        "unique": lambda: checks.assert_all_unique(orders, "o_orderkey"),
        "unique wrong": lambda: checks.assert_all_unique(people, "snz_uid"),
        "missing": lambda: checks.assert_size_missing(accidents, "accident_cause", ">=", 0),
        "missing wrong": lambda: checks.assert_size_missing(accidents, "accident_cause", "<", 0),
        "covered": lambda: checks.assert_join_covered(orders, customers, {"o_custkey": "c_custkey"}),
        "covered wrong": lambda: checks.assert_join_covered(accidents, people, "snz_uid"),
    }
    out = []
    for name, attempt in tries.items():
        try:
            out.append((name, True, attempt()))
        except AssertionError:
            out.append((name, False, None))
    return spark.createDataFrame(out, "name string, ok boolean, n bigint")


# Reshaping, reports, summaries


@query(
    f"""WITH a AS (SELECT snz_uid, {fold_sql('accident_cause')} AS cause FROM data_accidents)
SELECT snz_uid, cause, count(*) AS n FROM a WHERE cause IS NOT NULL GROUP BY ALL
UNION ALL SELECT snz_uid, NULL, count(DISTINCT cause) FROM a GROUP BY ALL"""
)
def pivot_causes(spark: SparkSession, folder: str) -> DataFrame:
    """Accidents by person and cause, pivoted with the causes found, some of them NULL, and given as the cells above 0; with
    cause NULL the number of a person's cells above 0, so that persons without a cause are there too."""
    rows = table(spark, folder, cohort.ACCIDENTS).select("snz_uid", folded(F.col("accident_cause")).alias("cause"), F.lit(1).cast("bigint").alias("n"))
    wide = reshape.pivot_table(rows, "cause", "n")
    labels = [c for c in wide.columns if c != "snz_uid"]
    cells = wide.select("snz_uid", F.expr("filter(array(" + ", ".join(f"struct('{c}' AS cause, `{c}` AS n)" for c in labels) + "), x -> x.n > 0)").alias("x"))
    each = F.explode(F.concat("x", F.array(F.struct(F.lit(None).cast("string").alias("cause"), F.size("x").cast("bigint").alias("n")))))
    return cells.select("snz_uid", each.alias("e")).select("snz_uid", "e.*")


@query("SELECT 'orders' AS report, true AS found, count(DISTINCT o_orderstatus) AS by_target FROM orders")
def rep_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A report on orders: whether it names every column, and how many target values it lists."""
    from pathlib import Path
    from tempfile import TemporaryDirectory

    orders = table(spark, folder, "orders").drop("o_comment")
    with TemporaryDirectory() as local:  # the report is the driver's own file
        name = profile.explore_report(orders, "o_orderkey", "o_orderstatus", "orders", local)
        text = Path(local, name).read_text()
    found = all(c in text for c in orders.columns if c != "o_orderkey") and name.endswith(" orders.html")
    return spark.createDataFrame([("orders", found, text.split("<h2>By")[1].count("<tr>"))], "report string, found boolean, by_target bigint")


@query(
    _values([("plain", 1, "a,b"), ("plain", 2, "a,c"), ("always", 1, "z,a,b"), ("within", 1, "a,b"), ("within", 2, "a"), ("across", 1, "a,b"), ("kept", 1, "a,b"), ("kept", 2, "b,a")], "case_, no, names")
    .replace("SELECT *", "SELECT case_, no::BIGINT AS no, names")
)
def sum_name_sets(spark: SparkSession, folder: str) -> DataFrame:
    sets = summarise.cross_product_column_names
    cases = {
        "plain": sets(["a"], ["b", "c"]),
        "always": sets(["a"], ["b"], always=["z"], drop_dupes_across=False),
        "within": sets(["a"], ["b", "a"]),
        "across": sets(["a", "b"], ["b", "a"])[:1],
        "kept": [x for x in sets(["a", "b"], ["a", "b"], drop_dupes_across=False) if len(x) == 2],
    }
    return spark.createDataFrame([(k, i, ",".join(x)) for k, v in cases.items() for i, x in enumerate(v, 1)], "case_ string, no bigint, names string")


_FORMATS = [
    ("col01 val01 summarised_var count", True), ("sum raw_count conf_count val01 col01", True), ("summarised_var distinct", True), ("count", True), ("col01 count", False),
    ("col01 val02 count", True), ("col1 val1 count", False), ("col01 val01 total", False), ("col01 val01 counted", False), ("col01 val01 raw_ count", False),
]


@query(_values(_FORMATS, "columns, fits"))
def sum_formats(spark: SparkSession, folder: str) -> DataFrame:
    fits = [(c, summarise.has_long_thin_format(spark.createDataFrame([], ", ".join(f"{x} string" for x in c.split())))) for c, _ in _FORMATS]
    return spark.createDataFrame(fits, "columns string, fits boolean")


# Release


@query("SELECT x, u, b, x - ((x % b) + b) % b + CASE WHEN ((x % b) + b) % b = 0 OR u < (b - ((x % b) + b) % b) / b::DOUBLE THEN 0 ELSE b END AS rounded, x % b = 0 AS multiple FROM "
       "(SELECT x, ((x * 7919 + 104729) % 1000) / 1000.0::DOUBLE AS u, b FROM (SELECT unnest(range(0, 200)) AS x), (SELECT unnest([3, 4, 5]) AS b))")  # fmt: skip
def round_local(spark: SparkSession, folder: str) -> DataFrame:
    """Rounding and the check of multiples on local values."""
    out = []
    for b in (3, 4, 5):
        xs = list(range(200))
        us = [(x * 7919 + 104729) % 1000 / 1000.0 for x in xs]
        rounded = confidential.round_values(xs, b, us)
        out += [(x, u, b, r, disclosure.check_rounding_to_base([x], b)) for x, u, r in zip(xs, us, rounded)]
    return spark.createDataFrame(out, "x bigint, u double, b int, rounded bigint, multiple boolean")


@query("SELECT n, true AS multiples, true AS near, true AS both_ways FROM (SELECT count(*) AS n FROM orders)")
def round_unseeded_ok(spark: SparkSession, folder: str) -> DataFrame:
    """Properties of rounding at random: multiples, less than the base away, in both directions."""
    rows = confidential.apply_random_rounding(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 5)
    d = F.col("conf_o_orderkey") - F.col("raw_o_orderkey")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.pmod("conf_o_orderkey", F.lit(5)) == 0).alias("multiples"), F.bool_and(F.abs(d) < 5).alias("near"),
        ((F.min(d) < 0) & (F.max(d) > 0)).alias("both_ways"),
    )


@query(
    _values([("down", True, "down", True), ("up", True, "up", True), ("far", True, "exceeds", True), ("raw", False, "up", True), ("none", None, "missing", True)], "how, multiples, word, warned")
)
def chk_random_rounding(spark: SparkSession, folder: str) -> DataFrame:
    """The check of random rounding on columns rounded in ways that are not random: its answer, and whether it warned of that."""
    n = table(spark, folder, "orders").select(F.col("o_orderkey").alias("raw")).where("raw % 3 <> 0")
    cols = {"down": "raw - raw % 3", "up": "raw + 3 - raw % 3", "far": "raw + 6 - raw % 3 - 9 * (raw % 2)", "none": "cast(null as bigint)"}
    df = n.select("raw", *[F.expr(x).alias(k) for k, x in cols.items()])
    words = {"down": "always down", "up": "always up", "far": "exceeds", "raw": "always up", "none": "missing"}
    out = []
    for how, word in words.items():
        with warnings.catch_warnings(record=True) as seen, redirect_stdout(io.StringIO()):
            warnings.simplefilter("always")
            ok = disclosure.check_random_rounding(df, "raw", how, print_ratios=True)
        out.append((how, None if how == "none" else ok, word.removeprefix("always "), any(word in str(w.message) for w in seen)))
    return spark.createDataFrame(out, "how string, multiples boolean, word string, warned boolean")


_PLAIN = cohort._CONF
SQL["release_report"] = f"""WITH {_PLAIN},
k AS (SELECT DISTINCT col01, col02, summarised_var FROM c),
v1 AS (SELECT DISTINCT col01, col02, summarised_var, val01 FROM c), v2 AS (SELECT DISTINCT col01, col02, summarised_var, val02 FROM c),
g AS (SELECT k.col01, v1.val01, k.col02, v2.val02, k.summarised_var FROM k
  JOIN v1 ON k.col01 = v1.col01 AND k.col02 IS NOT DISTINCT FROM v1.col02 JOIN v2 ON k.col01 = v2.col01 AND k.col02 IS NOT DISTINCT FROM v2.col02),
e AS (SELECT g.*, raw_distinct, raw_count, conf_sum, conf_distinct, conf_count FROM g LEFT JOIN c ON {cohort._SAME}),
a AS (SELECT bool_and(coalesce(conf_distinct % 3 = 0, true)) AS d, bool_and(coalesce(conf_count % 3 = 0, true)) AS n,
  NOT bool_or(coalesce(raw_distinct < 6, true) AND conf_distinct IS NOT NULL) AS sd, NOT bool_or(coalesce(raw_count < 6, true) AND conf_count IS NOT NULL) AS sn,
  NOT bool_or((coalesce(raw_count < 20, true) OR coalesce(raw_distinct < 20, true)) AND conf_sum IS NOT NULL) AS ss FROM e),
z AS (SELECT coalesce(bool_and(n = v1 * v2), true) AS ok FROM (SELECT count(*) AS n, count(DISTINCT coalesce(val01, '')) AS v1, count(DISTINCT coalesce(val02, '')) AS v2,
  bool_or(conf_count IS NULL) AS hidden FROM e GROUP BY col01, col02, summarised_var) WHERE hidden)
SELECT i::INT AS no, lpad(c, 13, ' ') || ' ' || lpad(t, 22, ' ') || ' : ' || CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS line FROM (
  SELECT 0 AS i, 'conf_distinct' AS c, 'checked for RR3' AS t, d AS ok FROM a UNION ALL SELECT 1, 'conf_distinct', 'suppressed if raw < 6', sd FROM a
  UNION ALL SELECT 2, 'conf_count', 'checked for RR3', n FROM a UNION ALL SELECT 3, 'conf_count', 'suppressed if raw < 6', sn FROM a
  UNION ALL SELECT 4, 'conf_sum', 'suppressed if raw < 20', ss FROM a UNION ALL SELECT 5, 'all', 'absence of zero counts', ok FROM z)"""


@query("SELECT 'Range' AS plan, true AS saved, true AS guided")
def wf_saved_plan(spark: SparkSession, folder: str) -> DataFrame:
    """A query's plan saved to a file on the driver, and the guidance on sessions."""
    from pathlib import Path
    from tempfile import TemporaryDirectory

    from tallyloom.session import connection_guidance

    with TemporaryDirectory() as local, redirect_stdout(io.StringIO()):
        path = catalog.save_plan(spark.range(3), "a range", local)
        text = Path(path).read_text()
        guided = "SparkSession" in connection_guidance() and catalog.save_plan(spark.range(3), "nothing") is None
    return spark.createDataFrame([("Range", "Range" in text, guided)], "plan string, saved boolean, guided boolean")
