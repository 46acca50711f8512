import random
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom import names
from tallyloom.operators import profile, reshape
from tallyloom.sources import catalog, files


def test_delimiters():
    assert names.is_delimited("[a]", "[]") and not names.is_delimited("[a", "[]") and names.is_delimited('"a"', '"')
    assert names.remove_delimiters("[text", "[]") == "text" and names.remove_delimiters("[odd][text]", "[]") == "odd][text"
    assert names.add_delimiters("a", "[]") == "[a]" == names.add_delimiters("[a]", "[]")
    assert names.has_internal_delimiters("[a[b]]", "[]") and names.has_internal_delimiters('"be\'fore"', '"')
    assert not names.has_internal_delimiters('"before"', '"') and not names.has_internal_delimiters("[it's]", "[]")
    for bad in ";'(){}?\"*":
        assert names.has_special_characters(f"a{bad}b")
    with pytest.raises(ValueError):
        names.is_delimited("a", "abc")


def test_names_and_messages(recwarn):
    assert names.catalog_name("[]", "[s]", "[t]") == "`s`.`t`"
    assert names.db_schema("[d]", "[s]") == "[d].[s]" and names.db_schema("", "[s]") == "[s]" and not recwarn
    names.warn_if_undelimited("[]")
    assert not recwarn
    names.warn_if_undelimited("")
    assert len(recwarn) == 1
    with pytest.raises(ValueError):
        names.db_schema("", "")
    with pytest.raises(ValueError):
        names.catalog_name(table="a;b")
    assert names.inform("go", "heading").endswith("| GO") and names.inform("go", "details").endswith("|  -- go") and names.inform("go", "all").endswith(" ---- go")


def test_table_life(spark):
    for t in ("made", "copied"):
        catalog.delete_table(spark, table=t)
    spec = {"number": "[int] NOT NULL", "date": "[date] NOT NULL", "character": "[varchar](25) NULL", "f": "[FLOAT](53)"}
    t = catalog.create_table(spark, spec, table="[made]")
    assert t.columns == list(spec) and t.count() == 0
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        catalog.create_table(spark, spec, table="[made]")
    source = spark.createDataFrame([(1, "a", 9)], "number int, character string, other int").withColumn("date", F.lit("2020-01-01").cast("date"))
    out = catalog.append_to_table(source, ["date", "number"], table="[made]")
    assert [r.asDict() for r in out.collect()][0] | {"date": 0} == {"number": 1, "date": 0, "character": None, "f": None}
    with pytest.raises(ValueError, match="missing in the target"):
        catalog.append_to_table(source, ["other"], table="[made]")
    with pytest.raises(ValueError, match="no table"):
        catalog.append_to_table(source, ["number"], table="[nowhere]")
    stored = catalog.copy_local(spark, pd.DataFrame({"a": range(1, 6), "b": list("abcde")}), table="copied")
    assert stored.count() == 5
    with pytest.raises(ValueError, match="exists"):
        catalog.write_table(stored, table="copied")
    again = catalog.rewrite_clustered(spark, ["b"], table="[copied]", buckets=4)
    assert again.count() == 5 and "bucket" in str(spark.sql("describe extended copied").collect()).lower()
    assert catalog.compress_table(spark, table="[copied]", codec="gzip").count() == 5
    assert catalog.layout(spark, table="[copied]") == {"bucket_by": ["b"], "buckets": 4, "sort_by": ["b"], "codec": "gzip"}
    assert catalog.rewrite_clustered(spark, ["a"], table="[copied]", buckets=2).count() == 5
    assert catalog.layout(spark, table="[copied]") == {"bucket_by": ["a"], "buckets": 2, "sort_by": ["a"], "codec": "gzip"}
    catalog.write_table(spark.range(5).withColumn("c", F.lit("x")), table="copied", overwrite=True, partition_by=["c"])
    assert catalog.compress_table(spark, table="copied").count() == 5 and catalog.layout(spark, table="copied") == {"partition_by": ["c"], "codec": "zstd"}
    assert catalog.write_for_reuse(spark.range(3), table="copied", index_columns=["id"]).count() == 3
    with pytest.raises(TypeError):
        catalog.copy_local(spark, stored, table="x")
    catalog.delete_table(spark, table="copied", mode="TABLE")
    assert not catalog.table_or_view_exists(spark, table="copied")
    with pytest.raises(ValueError):
        catalog.access_table(spark, table="copied")


def test_views_and_columns(spark):
    df = spark.range(3)
    catalog.delete_table(spark, table="seen", mode="view")
    assert catalog.create_view(df, "seen").count() == 3
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        catalog.create_view(df, "seen")
    assert catalog.create_view(df.limit(1), "seen", overwrite=True).count() == 1
    assert catalog.table_or_view_exists(spark, table="[seen]")
    catalog.delete_table(spark, table="seen", mode="view")
    assert not catalog.table_or_view_exists(spark, table="[seen]")
    spark.createDataFrame([(1,), (2,)], "n int").write.mode("overwrite").saveAsTable("seen_rows")
    catalog.delete_table(spark, table="lasting", mode="view")
    assert catalog.create_view("SELECT n FROM seen_rows WHERE n > 1", "lasting", schema="default").count() == 1
    assert "lasting" in [t.name for t in spark.catalog.listTables() if not t.isTemporary]
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        catalog.create_view("SELECT 1 AS n", "lasting")
    assert catalog.create_view("SELECT 5 AS n", "lasting", overwrite=True).first()[0] == 5
    catalog.delete_table(spark, table="lasting", mode="view", schema="[default]")
    assert not catalog.table_or_view_exists(spark, table="lasting")
    with pytest.raises(ValueError, match="belongs to no database"):
        catalog.create_view(df, "seen", schema="default")
    assert catalog.has_required_columns(df, ["id"], only=True) and not catalog.has_required_columns(df, ["ID"])
    with pytest.raises(ValueError, match="case"):
        catalog.check_case_clashes(["Fall", "fall"])


def test_statements_are_saved(spark, tmp_path):
    catalog.delete_table(spark, table="kept", plans=str(tmp_path))
    catalog.create_table(spark, {"n": "int"}, table="kept", plans=str(tmp_path))
    catalog.create_view("SELECT 1 AS n", "kept_view", True, plans=str(tmp_path))
    catalog.delete_table(spark, table="kept_view", mode="view")
    catalog.delete_table(spark, table="kept")
    texts = sorted(p.read_text().split()[0] for p in tmp_path.glob("*.sql"))
    assert texts == ["CREATE", "DROP", "SELECT"]


def test_an_append_leaves_views_alone(spark):
    spark.range(7).createOrReplaceTempView("tallyloom_append")
    catalog.create_table(spark, {"id": "bigint"}, table="target", overwrite=True)
    assert catalog.append_to_table(spark.range(2), ["id"], table="target").count() == 2 and spark.table("tallyloom_append").count() == 7
    catalog.delete_table(spark, table="target")


def test_saved_plans(spark, tmp_path):
    assert catalog.save_plan(spark.range(1), "x") is None
    path = catalog.save_plan(spark.range(1), "make. it: so", str(tmp_path / "new"))
    assert path.endswith("make__it__so.sql") and "Range" in open(path).read()
    (tmp_path / "file").write_text("")
    with pytest.warns(UserWarning):
        catalog.save_plan(spark.range(1), "x", str(tmp_path / "file" / "under"))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sql,txt\n[a],"""fall"""\n[b],"x, y"\n')
    assert [tuple(r) for r in files.read_table_file(spark, str(tmp_path / "a.csv")).collect()] == [("[a]", '"fall"'), ("[b]", "x, y")]
    with pytest.raises(ValueError):
        files.read_table_file(spark, "a.txt")
    df = spark.createDataFrame([('a "q", b', None)], "t string, n int")
    files.write_results_csv(df, str(tmp_path / "out"))
    back = files.read_table_file(spark, str(max((tmp_path / "out").glob("*.csv"), key=lambda p: p.stat().st_size)))
    assert [tuple(r) for r in back.collect()] == [('a "q", b', None)]


def test_union_and_pivot(spark):
    a = spark.createDataFrame([(1, "x", 0)], "n int, s string, z int")
    b = spark.createDataFrame([("y", 2), ("y", 2)], "s string, n int")
    assert sorted(map(tuple, reshape.union_all(a, b, ["n", "s"]).collect())) == [(1, "x"), (2, "y"), (2, "y")]
    with pytest.raises(ValueError):
        reshape.union_all(a, b, [])
    with pytest.raises(ValueError):
        reshape.union_all(a, b, ["z"])
    long = spark.createDataFrame([("bob", "age", 10.0), ("alice", "age", 12.0), ("bob", "height", 150.0), ("alice", "height", 160.0)], "people string, labels string, v double")
    assert sorted(map(tuple, reshape.pivot_table(long, "labels", "v").collect())) == [("alice", 12, 160), ("bob", 10, 150)]


def test_pivot_zero_and_null(spark):
    rows = [(1, "a", 5.0), (1, "a", None), (2, "b=x", None), (3, None, 4.0), (4, "b=x", None), (4, "a", 1.0), (None, "a", 2.0)]
    df = spark.createDataFrame(rows, "k int, l string, v double")
    out = reshape.pivot_table(df, "l", "v")
    assert out.columns == ["k", "a", "b=x"]
    got = {r["k"]: (r["a"], r["b=x"]) for r in out.collect()}
    assert got == {1: (5, 0), 2: (0, None), 3: (None, None), 4: (1, 0), None: (2, 0)}


@pytest.mark.parametrize("fill", [0, 2.5, -1, None])
def test_named_aggregates_equal_those_by_label(spark, fill):
    """What goes by cells agrees with the aggregate of value or fill over all of a group's rows."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["a", "it's", "c\\d", None]), rng.choice([None, -2.0, 0.0, 1.5, 4.0])) for _ in range(60)]
    rows += [(9, None, 1.0), (8, "a", None), (7, "a", 2.0)]
    df = spark.createDataFrame(rows, "k int, l string, v double")
    for name, f in (("sum", F.sum), ("min", F.min), ("max", F.max), ("avg", F.avg), ("count", F.count)):
        got, want = reshape.pivot_table(df, "l", "v", name, fill), reshape.pivot_table(df, "l", "v", f, fill)
        assert got.columns == want.columns == ["k", "a", "c\\d", "it's"]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    with pytest.raises(ValueError, match="aggregator"):
        reshape.pivot_table(df, "l", "v", "median")


def test_a_pivot_of_many_labels(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), (F.col("id") % 1500).cast("string").alias("l"), F.lit(1).alias("v"))
    out = reshape.pivot_table(df, "l", "v")
    assert len(out.columns) == 1501
    assert sorted(sum(r[1:]) for r in out.collect()) == [3000, 3000]


def test_pivot_aggregators_and_clashes(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", 7.0)], "k int, l string, v double")
    assert tuple(reshape.pivot_table(df, "l", "v", "min").first()) == (1, 0, 0)
    assert tuple(reshape.pivot_table(df, "l", "v", "min", fill=None).first()) == (1, 5, 7)
    with pytest.raises(ValueError, match="case"):
        reshape.pivot_table(spark.createDataFrame([(1, "Fall", 1), (1, "fall", 1)], "k int, l string, v int"), "l", "v").collect()


def test_collapse(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 0.0), (2, 0.0, 2.0, 1.0), (3, 0.0, 0.0, 1.0), (4, None, 0.0, 0.0)], "id int, v_a double, v_b double, v_c double")
    pick = lambda yes: [r["v_"] for r in reshape.collapse_indicator_columns(df, "v_", yes).orderBy("id").collect()]
    assert pick([1]) == ["a", "c", "c", None] and pick([1, 2]) == ["a", "b", "c", None]
    with pytest.warns(UserWarning):
        assert reshape.collapse_indicator_columns(df, "zz", [1]).columns == df.columns


def test_samples_and_report(spark, tmp_path):
    df = spark.range(1, 101).select("id", (F.col("id") % 3).alias("c.1"), F.lit("x").alias("s"))
    assert profile.limited_rows(df, 200, "id").count() == 100
    assert [r["id"] for r in profile.limited_rows(df, 10, "id").orderBy("id").collect()] == list(range(10, 101, 10))
    assert profile.limited_rows(df, 7).count() == 7
    name = profile.explore_report(df, "id", "c.1", "my table", str(tmp_path))
    assert name.endswith(" my table.html") and "mean" in (tmp_path / name).read_text()
    got = {r["column"]: r for r in profile.profile_columns(df)}
    assert got["id"]["min"] == "1" and got["id"]["max"] == "100" and got["id"]["mean"] == 50.5 and got["c.1"]["top"][0] == ("1", 34)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert profile.profile_columns(df.where("false"))[0]["rows"] == 0


def test_different_values_are_counted_exactly(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 7001).cast("string").alias("s"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("z"), F.lit(None).cast("int").alias("n"))
    assert [r["distinct"] for r in profile.profile_columns(df)] == [30_000, 7001, 1, 0]


def test_report_has_all_target_values(spark, tmp_path):
    df = spark.range(300).select("id", F.concat(F.lit("kind"), F.col("id") % 150).alias("k"))
    name = profile.explore_report(df, target="k", output_dir=str(tmp_path))
    by = (tmp_path / name).read_text().split("<h2>By k</h2>")[1]
    assert all(f"<td>kind{i}</td>" in by for i in range(150))
