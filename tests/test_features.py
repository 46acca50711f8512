import datetime as dt
import random

from pyspark.sql import functions as F

from tallyloom.operators import features as f

D = dt.date
EVENTS = "who bigint, what int, day date, x double, entity string, type string"


def rows_of(spark, rows, spans):
    df = spark.createDataFrame(rows, EVENTS)
    out = f.asof_features(f.cumulative_store(df, "who", "what", "day", "x"), spans)
    return {(r["entity"], r["type"]): r for r in out.collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        day = None if rng.random() < 0.1 else D(2020, 1, 1) + dt.timedelta(rng.randrange(60))
        x = None if rng.random() < 0.2 else rng.randrange(-8, 9) / 4
        rows.append((rng.choice([1, 2, 3, None]), rng.choice([1, 2, None]), day, x, "e", "t"))
    spans = {"feb": (D(2020, 2, 1), D(2020, 2, 20)), "since": ("2020-02-10", None), "until": (None, "2020-01-15"), "ever": (None, None)}
    got = rows_of(spark, rows, spans)
    assert len(got) == 9
    for (who, what), r in got.items():
        for name, (a, b) in spans.items():
            a = D.fromisoformat(a) if isinstance(a, str) else a
            b = D.fromisoformat(b) if isinstance(b, str) else b
            mine = [q for q in rows if q[0] == who and q[1] == what]
            mine = [q for q in mine if (q[2] is None and a is None) or (q[2] is not None and (a is None or q[2] >= a) and (b is None or q[2] <= b))]
            days = {q[2] for q in mine} - {None}
            paid = [q[3] for q in mine if q[3] is not None]
            assert r[name]["n"] == len(mine), (who, what, name)
            assert r[name]["days"] == len(days)
            assert r[name]["last_day"] == max(days, default=None)
            assert r[name]["total"] == (sum(paid) if paid else None)


def test_empty_table(spark):
    assert rows_of(spark, [], {"ever": (None, None)}) == {}


def test_rows_and_columns(spark):
    rows = [(1, 1, D(2020, 1, 1), None, "", ""), (1, 1, D(2020, 1, 1), None, "", ""), (1, None, D(2020, 1, 3), 2.0, "", ""), (2, None, None, None, "", "")]
    df = spark.createDataFrame(rows, EVENTS)
    feats = f.asof_features(f.cumulative_store(df, "who", "what", "day", "x"), {"ever": (None, None)})
    wide = f.wide_features(f.entity_rows(feats, ["ever"]), "ever", [1, 2], keep=[F.col("untyped.ever.n").alias("other")])
    got = {r["entity"]: r.asDict() for r in wide.collect()}
    assert got[1] == {"entity": 1, "other": 1, "c1_n": 2, "c1_last": D(2020, 1, 1), "c2_n": 0, "c2_last": None}
    assert got[2] == {"entity": 2, "other": 1, "c1_n": 0, "c1_last": None, "c2_n": 0, "c2_last": None}


def test_one_type_for_all(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1))], "who bigint, day date")
    r = f.cumulative_store(df, "who", None, "day", type_value=7).first()
    assert (r["type"], r["cum_n"], r["cum_days"], r["cum_low"]) == (7, 1, 1, 0.0)


def test_hot_entity_is_reduced_before_the_window(spark):
    """Many events of one entity on few days become few rows."""
    df = spark.range(20000).select(F.lit(1).alias("who"), F.lit(1).alias("what"), F.date_add(F.lit(D(2020, 1, 1)), (F.col("id") % 5).cast("int")).alias("day"))
    store = f.cumulative_store(df, "who", "what", "day")
    assert store.count() == 5
    assert store.agg(F.max("cum_n")).first()[0] == 20000


def test_totals_survive_what_lies_outside_the_window(spark):
    nan, inf, day = float("nan"), float("inf"), lambda y: D(y, 6, 1)
    rows = []
    for who, before in ((1, [nan]), (2, [1e17]), (3, [inf, -inf]), (4, [1e300, -3e25]), (5, [])):
        rows += [(who, 1, day(2019), x, "", "") for x in before] + [(who, 1, day(2021), 5.0, "", ""), (who, 1, day(2021), 0.25, "", "")]
    rows += [(6, 1, day(2021), nan, "", ""), (7, 1, day(2021), inf, "", ""), (8, 1, day(2021), inf, "", ""), (8, 1, day(2022), -inf, "", ""), (9, 1, day(2021), None, "", "")]
    rows += [(10, 1, day(2021), 1e17, "", ""), (10, 1, day(2021), 3.0, "", ""), (10, 1, day(2022), -1e17, "", "")]
    got = rows_of(spark, rows, {"late": (D(2020, 1, 1), None), "early": (None, D(2020, 1, 1))})
    late = {k[0]: r["late"]["total"] for k, r in got.items()}
    assert [late[w] for w in (1, 2, 3, 4, 5, 7, 9, 10)] == [5.25] * 5 + [inf, None, 3.0]
    assert late[6] != late[6] and late[8] != late[8]
    early = {k[0]: r["early"]["total"] for k, r in got.items()}
    assert early[2] == 1e17 and early[4] == 1e300 and early[1] != early[1] and early[3] != early[3] and early[5] is None


def test_a_kept_store_is_extended(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 3]), rng.choice([1, None]), None if rng.random() < 0.1 else D(2020, 1, 1) + dt.timedelta(rng.randrange(40)), rng.choice([None, 1.5, 2.0, 1e17, float("nan")]), "e", "t") for _ in range(300)]
    spans = {"feb": (D(2020, 1, 12), D(2020, 2, 1)), "ever": (None, None)}
    store = f.FeatureStore(spark, f"file://{tmp_path}/store", 3)
    assert store.read() is None
    for i in range(3):
        df = spark.createDataFrame(rows[i::3], EVENTS)
        assert store.append(f.daily(df, "who", "what", "day", "x")) == i
    store.append(f.daily(df, "who", "what", "day", "x"), 2)  # the last append made again
    out = f.asof_features(store.read(), spans)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["entity"], r["type"]): str(r) for r in out.collect()} == {k: str(r) for k, r in rows_of(spark, rows, spans).items()}


def test_type_names_are_quoted(spark):
    df = spark.createDataFrame([(1, "it's", D(2020, 1, 1))], "who bigint, what string, day date")
    feats = f.asof_features(f.cumulative_store(df, "who", "what", "day"), {"ever": (None, None)})
    assert f.wide_features(f.entity_rows(feats, ["ever"]), "ever", ["it's", "b"]).first().asDict() == {"entity": 1, "cit's_n": 1, "cit's_last": D(2020, 1, 1), "cb_n": 0, "cb_last": None}
