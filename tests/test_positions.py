from pyspark.sql import functions as F

from tallyloom.operators.positions import with_positions


def test_positions_are_consecutive_in_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"), F.lit("x").alias("position_of"))
    got = with_positions(df, ["k"], 5).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1000))
    assert [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_nulls_first_and_empty(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "k int")
    assert [(r["k"], r["position"]) for r in with_positions(df, ["k"]).orderBy("position").collect()] == [(None, 0), (1, 1), (3, 2)]
    assert with_positions(df.where("false"), ["k"]).count() == 0
