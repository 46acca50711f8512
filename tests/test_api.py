import pytest
from pyspark.sql import functions as F

from tallyloom import api


def test_not_in_and_bind_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert [r[0] for r in df.where(api.not_in(F.col("s"), ["a"])).collect()] == ["b", None]
    assert [r[0] for r in df.where(api.not_in(F.col("s"), ["a", None])).collect()] == ["b"]
    assert df.where(api.not_in(F.col("s"), [])).count() == 3
    out = api.bind_rows(df.limit(1), spark.createDataFrame([(1, "x")], "n int, s string"))
    assert [tuple(r) for r in out.collect()] == [("a", None), ("x", 1)]


def test_local_rounding():
    assert api.randomly_round_vector([3, 4, 4, 5, -4, None], 3, [0.9, 0.6, 0.7, 0.3, 0.2, 0.5]) == [3, 3, 6, 3, -6, None]
    got = [api.randomly_round_vector([7], 5)[0] for _ in range(200)]
    assert set(got) == {5, 10}
    with pytest.raises(ValueError):
        api.randomly_round_vector([1], 3, [])


def test_example_runs(spark, tmp_path):
    paths = {p.rsplit("/", 1)[1][:-4]: p for p in api.provide_assembly_tool_example(str(tmp_path))}
    for name in ("example_readers", "example_loans"):
        spark.read.csv(paths[name], header=True, inferSchema=True).createOrReplaceTempView(name)
    long, wide = api.dataset_assembly_tool(spark, paths["control_population"], paths["control_measures"], silent=True)
    assert wide is None
    got = {(r["identity_column"], r["label_identity"], r["label_measure"]): r["value_measure"] for r in long.collect()}
    assert got == {
        (11, "first_term", "loans"): 2, (11, "first_term", "fees_in_term"): pytest.approx(2.5 * 11 / 20), (11, "first_term", "shelf=maps"): 1,
        (11, "first_term", "shelf=novels"): 1, (12, "first_term", "loans"): 1, (12, "first_term", "fees_in_term"): 1.25,
        (12, "first_term", "shelf=novels"): 1, (12, "spring", "loans"): 1, (12, "spring", "fees_in_term"): 4, (12, "spring", "shelf=poetry"): 1,
    }
    assert "SparkSession" in api.display_connection_guidance()


def test_scratch_tables_can_be_dropped(spark):
    from tallyloom.session import drop_shared, write_shared

    df = write_shared(spark.range(3))
    assert df.count() == 3
    drop_shared(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_folded_labels(spark):
    from tallyloom.functions import folded

    cases = {'"Cause" = A-1': "causea1", "": None, " ._": None, "é2\u212a": "2", "a\x00B\x7f\n": "ab", "Ünï C9": "nc9", None: None}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, w string")
    assert [(r["k"], r["w"]) for r in df.select(folded(F.col("s")).alias("k"), "w").collect() if r["k"] != r["w"]] == []
