import datetime as dt

from pyspark.sql import functions as F

from tallyloom.llm import sample as s

T0 = dt.datetime(2020, 1, 1)
SCHEMA = "who bigint, at timestamp, seq string, id string, first_arrived string"


def people(spark, n, step=7):
    rows = [((i * 7919) % 100003, T0 + dt.timedelta(hours=i // step), "s", "i", "f") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return {r[0] for r in df.collect()}


def test_members_stay_as_data_grows(spark):
    df = people(spark, 4000)
    before = {}
    for hours in (50, 200, 400, 600):
        state = df.where(F.col("at") <= F.lit(T0 + dt.timedelta(hours=hours)))
        now = {r["who"]: r["seq"] for r in s.golden_sample(state, "who", "at", 0.1).collect()}
        assert before.items() <= now.items()
        n = state.select("who").distinct().count()
        assert abs(len(now) - n / 10) <= 3
        before = now


def test_same_for_any_order_partitions_and_repeats(spark):
    df = people(spark, 1500)
    want = ids(s.golden_sample(df, "who", "at", 0.1))
    later = df.where("who % 3 = 0").withColumn("at", F.col("at") + F.expr("interval 1 year"))
    assert ids(s.golden_sample(df.unionByName(later).repartition(13, "at"), "who", "at", 0.1)) == want
    assert ids(s.golden_sample(df.orderBy(F.desc("who")).coalesce(1), "who", "at", 0.1)) == want


def test_even_over_every_stretch_and_nested_rates(spark):
    seq = spark.range(100_000).select("id", s.point(F.col("id")).alias("p"))
    hits = [r["id"] for r in seq.where(F.col("p") < int(0.1 * 2**42)).orderBy("id").collect()]
    for a in range(0, 100_000, 1000):
        assert abs(sum(a <= h < a + 1000 for h in hits) - 100) <= 3
    gaps = {b - a for a, b in zip(hits, hits[1:])}
    assert len(gaps) <= 3  # as the three-distance theorem has it
    df = people(spark, 2000)
    assert ids(s.golden_sample(df, "who", "at", 0.1)) <= ids(s.golden_sample(df, "who", "at", 0.25))


def test_points_agree_with_whole_numbers(spark):
    some = [0, 1, 2, 2**21 - 1, 2**21, 2**31 + 5, 2**41 + 12345, 2**42 - 1]
    df = spark.createDataFrame([(x,) for x in some], "n bigint")
    got = {r["n"]: r["p"] for r in df.select("n", s.point(F.col("n")).alias("p")).collect()}
    assert got == {x: (x * s.GOLDEN + s.SHIFT) % 2**42 for x in some}
    assert s.GOLDEN % 2 == 1


def test_rows_of_the_sample(spark):
    df = people(spark, 500)
    chosen = s.golden_sample(df, "who", "at", 0.2)
    rows = spark.createDataFrame([(r["who"], i, "x") for r in df.collect() for i in range(2)] + [(None, 0, "x")], "member bigint, i int, who string")
    got = s.rows_of_sample(rows, "member", chosen, "who")
    assert got.columns == rows.columns
    assert got.count() == 2 * chosen.count() and ids(got) == ids(chosen)


def test_nulls_rates_and_empty(spark):
    df = spark.createDataFrame([(None, T0, "", "", ""), (5, None, "", "", ""), (4, T0, "", "", "")], SCHEMA)
    assert [(r["who"], r["seq"]) for r in s.sequence_numbers(df, "who", "at").orderBy("seq").collect()] == [(4, 0), (5, 1)]
    assert s.golden_sample(df, "who", "at", 1.0).count() == 2 and s.golden_sample(df, "who", "at", 0.0).count() == 0
    assert s.golden_sample(df.where("false"), "who", "at", 0.5).count() == 0


def test_a_register_loses_no_member(spark, tmp_path):
    """Members without arrival, dated before all, tied with others or with lesser ids come; known members come again."""
    r = s.Register(spark, f"file://{tmp_path}/register", 3)
    first = people(spark, 200)
    assert r.load(first, "who", "at") == 200
    before = {x["id"]: x["seq"] for x in r.members().collect()}
    rows = [(-1, None), (-2, T0 - dt.timedelta(days=9)), (-3, T0), (-4, T0), (None, T0)]
    rows += [(x["who"], None) for x in first.limit(50).collect()] + [(x["who"], T0 - dt.timedelta(days=99)) for x in first.limit(90).collect()]
    more = spark.createDataFrame(rows, "who bigint, at timestamp").withColumn("id", F.lit("x"))
    assert r.load(more, "who", "at") == 4
    now = {x["id"]: x["seq"] for x in r.members().collect()}
    assert before.items() <= now.items()
    assert {k: v for k, v in now.items() if k not in before} == {-2: 200, -4: 201, -3: 202, -1: 203}
    assert r.load(more, "who", "at") == 0 and r.load(more.where("false"), "who", "at") == 0
    assert {x["load"] for x in r.members().collect()} == {0, 1}
    again = s.golden_sample(first.where("false"), "who", "at", 0.1, register=f"file://{tmp_path}/register")
    assert ids(again) == {k for k, v in now.items() if (v * s.GOLDEN + s.SHIFT) % 2**42 < int(0.1 * 2**42)}


def test_a_register_is_not_shuffled_when_it_grows(spark, tmp_path):
    r = s.Register(spark, f"file://{tmp_path}/register", 3)
    r.load(people(spark, 100), "who", "at")
    plan = r.members().groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
