import itertools
import warnings

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import confidential as c
from tallyloom.operators import disclosure as d
from tallyloom.operators import summarise as s


def rows(df, *cols):
    return sorted(tuple(r[x] for x in cols) for r in df.collect())


@pytest.fixture
def cycling(spark):
    vals = [0, 0, None, 1, 2]
    return spark.createDataFrame([("z" if i < 50 else "y", "ab"[i % 2], i + 1, vals[i % 5], 1.0 if i % 2 else 2.5) for i in range(100)], "your_label string, my_label string, rownum int, v int, c2 double")


def test_names():
    assert s.cross_product_column_names(["a", "b"], ["a", "c"], always=["z"]) == [["a", "z"], ["a", "c", "z"], ["a", "b", "z"], ["b", "c", "z"]]
    assert s.cross_product_column_names(["a"], ["a"], drop_dupes_within=False) == [["a", "a"]]
    assert len(s.cross_product_column_names(["a", "b"], ["a", "b"], drop_dupes_across=False)) == 4


def test_format(spark):
    ok = spark.createDataFrame([], "val01 string, col01 string, count int, raw_sum int, summarised_var string")
    assert s.has_long_thin_format(ok) and s.has_long_thin_format(ok.drop("summarised_var"))
    assert not s.has_long_thin_format(ok.drop("val01")) and not s.has_long_thin_format(ok.withColumn("x", F.lit(1)))


def test_summary(cycling):
    out = s.summarise_and_label(cycling, ["your_label", "my_label"], "rownum", True, True, True)
    assert out.columns == ["col01", "val01", "col02", "val02", "summarised_var", "distinct", "count", "sum"]
    assert rows(out, "val01", "val02", "distinct", "count", "sum") == [("y", "a", 25, 25, 1875), ("y", "b", 25, 25, 1900), ("z", "a", 25, 25, 625), ("z", "b", 25, 25, 650)]


@pytest.mark.parametrize(("clean", "want"), [("none", (3, 20, 15)), ("zero.as.na", (2, 10, 15)), ("na.as.zero", (3, 25, 15))])
def test_cleaning(cycling, clean, want):
    out = s.summarise_and_label(cycling, ["your_label", "my_label"], "v", True, True, True, clean)
    assert rows(out, "distinct", "count", "sum") == [want] * 4


def test_numbers_as_text_and_missing_groups(cycling):
    assert rows(s.summarise_and_label(cycling, ["c2"], "rownum", make_count=True), "val01") == [("1",), ("2.5",)]
    assert rows(s.summarise_and_label(cycling, ["v"], "rownum", make_sum=True), "val01", "sum") == [("0", 1960), ("1", 1030), ("2", 1050)]
    kept = s.summarise_and_label(cycling, ["v"], "rownum", make_sum=True, remove_na_from_groups=False)
    assert sorted((r["val01"] or "", r["sum"]) for r in kept.collect()) == [("", 1010), ("0", 1960), ("1", 1030), ("2", 1050)]
    with pytest.raises(ValueError):
        s.summarise_and_label(cycling, ["v"], "rownum")
    with pytest.raises(ValueError):
        s.summarise_and_label(cycling, ["zz"], "rownum", True)


@pytest.mark.parametrize("remove", [True, False])
@pytest.mark.parametrize("clean", s.CLEAN)
def test_lists_equal_single_calls(cycling, remove, clean):
    groups, sums = [["your_label"], ["v", "my_label"], ["my_label", "v"], ["v"], []], ["rownum", "v"]
    if clean != "none":
        groups = groups[:-1]
    got = s.summarise_and_label_over_lists(cycling, groups, sums, True, True, True, clean, remove)
    want = None
    for g, x in itertools.product(groups, sums):
        one = s.summarise_and_label(cycling, g, x, True, True, True, clean, remove)
        want = one if want is None else want.unionByName(one, allowMissingColumns=True)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_one_shuffle_for_all_groupings(cycling):
    got = s.summarise_and_label_over_lists(cycling, [["your_label"], ["my_label"], ["v"]], ["rownum"], make_count=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# Rounding


def rounding_frame(spark):
    return spark.range(10000).select(F.concat(F.lit("l"), "id").alias("a"), F.concat(F.lit("m"), (F.col("id") * 7)).alias("b"), (F.col("id") % 60 - 20).cast("int").alias("n"), (F.col("id") % 3000).alias("m"))


@pytest.mark.parametrize("base", [2, 3, 5, 7])
@pytest.mark.parametrize("stable", [None, ["a", "b"]])
def test_random_rounding(spark, base, stable):
    out = c.apply_random_rounding(rounding_frame(spark), ["n"], base, stable).withColumn("r", F.pmod("raw_n", F.lit(base))).withColumn("d", F.col("conf_n") - F.col("raw_n"))
    bad = out.where((F.pmod("conf_n", F.lit(base)) != 0) | (F.abs("d") >= base) | ((F.col("r") == 0) & (F.col("d") != 0)))
    assert bad.count() == 0
    for r in out.where("r > 0").groupBy("r").agg(F.avg((F.col("d") < 0).cast("int")).alias("down"), F.count("*").alias("n")).collect():
        assert abs(r["down"] - (base - r["r"]) / base) < 5 / r["n"] ** 0.5


def test_stable_rounding_depends_on_labels_only(spark):
    df = rounding_frame(spark)
    one = c.apply_random_rounding(df, ["n", "m"], 3, ["a", "b"])
    other = c.apply_random_rounding(df.repartition(7), ["m", "n"], 3, ["b", "a"])
    swapped = c.apply_random_rounding(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "m"), ["n"], 3, ["a", "b"])
    assert rows(one, "a", "conf_n", "conf_m") == rows(other, "a", "conf_n", "conf_m")
    assert [r[1] for r in rows(one, "a", "conf_n")] == [r[1] for r in rows(swapped, "b", "conf_n")]
    with pytest.raises(ValueError):
        c.apply_random_rounding(df, ["n"], 3, ["n"])


def test_graduated_rounding(spark):
    df = spark.range(-3000, 3001).select(F.col("id").alias("n"), F.col("id").cast("string").alias("a")).unionByName(spark.createDataFrame([(None, "x")], "n bigint, a string"))
    out = c.apply_graduated_random_rounding(df, ["n"], ["a"]).cache()
    assert d.check_graduated_rounding_df(out, "conf_n")
    base = lambda x: 3 if x < 19 else 2 if x < 20 else 5 if x < 100 else 10 if x < 1000 else 100
    for raw, conf in out.select("raw_n", "conf_n").collect():
        assert (raw is None and conf is None) or (conf % base(abs(raw)) == 0 and abs(conf - raw) < base(abs(raw)))


def test_suppression(spark):
    df = spark.createDataFrame([(i, i + 2, i + 10, "x") for i in range(1, 11)] + [(None, 1, 5, "x"), (9, None, 5, "x")], "d int, n int, s int, l string")
    got = c.apply_small_count_suppression(df, ["s"], [3, 6], ["d", "n"]).collect()
    for (dd, n, t, _), r in zip(df.collect(), got):
        assert r["s"] == (None if (dd is not None and dd < 3) or (n is not None and n < 6) else t)
    own = c.apply_small_count_suppression(df, ["d", "n"], 5).collect()
    assert [r["d"] for r in own][:6] == [None, None, None, None, 5, 6]
    with pytest.raises(ValueError):
        c.apply_small_count_suppression(df, ["s"], [1, 2], ["d"])


def summary(spark, rows):
    return spark.createDataFrame(rows, "col01 string, val01 string, summarised_var string, `distinct` int, `count` int, `sum` int")


@pytest.mark.parametrize("stable", [True, False])
def test_confidentialise_keeps_the_sides_of_the_threshold(spark, stable):
    df = summary(spark, [("a", f"v{i}", "x", n, n, n * 9) for i in range(100) for n in (5, 6, 19, 20)])
    out = c.confidentialise_results(df, stable_rr=stable).collect()
    assert len(out) == 400
    for r in out:
        assert (r["conf_count"] is None) == (r["raw_count"] < 6) and (r["conf_sum"] is None) == (r["raw_count"] < 20)
        if r["raw_count"] in (19, 20):
            assert r["conf_count"] == {19: 18, 20: 21}[r["raw_count"]] == r["conf_distinct"]
    with pytest.raises(ValueError):
        c.confidentialise_results(df.drop("val01"))
    with pytest.raises(ValueError):
        c.confidentialise_results(df.drop("distinct", "count"))


def test_confidentialise_rounds_sums_if_asked(spark):
    df = summary(spark, [("a", f"v{i}", "x", 30, 31, 100 + i) for i in range(30)])
    out = c.confidentialise_results(df, stable_rr=True, sum_rr=True)
    assert d.check_rounding_to_base_df(out, "conf_sum") and "raw_sum" in out.columns


# Checks of what is released


@given(st.lists(st.one_of(st.none(), st.integers(-30, 30)), min_size=1), st.integers(2, 5))
def test_local_multiples(values, base):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert d.check_rounding_to_base(values, base) == all(v % base == 0 for v in values if v is not None)


def test_rounding_checks(spark):
    df = spark.createDataFrame([(i, i // 3 * 3, i if i % 3 == 0 else i // 3 * 3 + 3, i + 6 - i % 3, None) for i in range(1, 23)], "raw int, down int, up int, far int, none int")
    assert d.check_rounding_to_base_df(df, "down") and not d.check_rounding_to_base_df(df, "raw")
    with pytest.warns(UserWarning, match="down"):
        assert d.check_random_rounding(df, "raw", "down")
    with pytest.warns(UserWarning, match="up"):
        assert d.check_random_rounding(df, "raw", "up")
    with pytest.warns(UserWarning, match="exceeds"):
        assert d.check_random_rounding(df, "raw", "far")
    with pytest.warns(UserWarning, match="missing"):
        assert d.check_rounding_to_base_df(df, "none")
    assert not d.check_rounding_to_base_df(df.selectExpr("if(raw = 1, null, down) as x"), "x", na_rm=False)
    with pytest.raises(ValueError):
        d.check_rounding_to_base_df(df.where("false"), "raw")


def test_suppression_check(spark):
    df = spark.range(1, 31).selectExpr("id as raw_count", "if(id < 6, null, id) as conf_count", "if(id < 20, null, id) as conf_sum")
    assert d.check_small_count_suppression(df, "conf_count", 6, "raw_count") and d.check_small_count_suppression(df, "conf_sum", 20, "raw_count")
    assert not d.check_small_count_suppression(df, "conf_count", 7, "raw_count") and not d.check_small_count_suppression(df.selectExpr("null as n", "1 as s"), "s", 6, "n")


def zero_frame(spark):
    one = [("eth", e, "sex", x, "id", 9) for e in "abc" for x in "mf"]
    two = [("region", r, "eth", e, "id", 9) for r in "1234" for e in "abc"]
    return [(*r[:5], None if i % 5 == 0 else r[5]) for i, r in enumerate(one + two)], "col01 string, val01 string, col02 string, val02 string, summarised_var string, conf_count int"


def test_zero_counts_leave_one_out(spark):
    full, schema = zero_frame(spark)
    assert d.check_absence_of_zero_counts(spark.createDataFrame(full, schema), "conf_count")
    for i in (0, 3, 7, 17):
        part = spark.createDataFrame(full[:i] + full[i + 1 :], schema)
        assert not d.check_absence_of_zero_counts(part, "conf_count", print_on_fail=True)
        out = d.expand_to_include_zero_counts(part)
        assert out.columns == part.columns
        want = full[:i] + [(*full[i][:5], None)] + full[i + 1 :]
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    shown = [(*r[:5], 9) for r in full][1:]
    assert d.check_absence_of_zero_counts(spark.createDataFrame(shown, schema), "conf_count")


def test_expand_treats_null_as_a_value(spark):
    df = spark.createDataFrame([("a", None, None, None, "x", 1), ("a", "1", None, None, "x", 2)], zero_frame(spark)[1])
    assert sorted(map(str, map(tuple, d.expand_to_include_zero_counts(df).collect()))) == sorted(map(str, map(tuple, df.collect())))


def test_report(spark):
    df = summary(spark, [("a", f"v{i}", "x", n, n, n * 9) for i in range(40) for n in (3, 10, 11, 25)])
    out = c.confidentialise_results(df, stable_rr=True)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        lines = d.check_confidentialised_results(out)
        assert len(lines) == 6 and all(x.endswith(": PASS") for x in lines) and len({len(x.split(":")[0]) for x in lines}) == 1
        assert [x.split(": ")[1] for x in d.check_confidentialised_results(out.drop("conf_sum", "raw_distinct"))] == ["SKIP", "SKIP", "PASS", "PASS", "SKIP", "PASS"]
        assert d.check_confidentialised_results(out.withColumn("conf_count", F.col("raw_count")))[2].endswith("FAIL")
