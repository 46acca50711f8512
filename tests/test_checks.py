import datetime as dt
import itertools
import random

import pytest

import __spark_entry__ as entry
from tallyloom.operators import checks as k

D = dt.date


def test_compare():
    assert k.compare(1, "<", 2) and k.compare(2, "!=", 3) and not k.compare(2, ">=", 3)
    for bad in ("1", None, float("nan"), True):
        with pytest.raises(TypeError):
            k.compare(bad, "<", 2)
    with pytest.raises(ValueError):
        k.compare(1, "=<", 2)


def test_sizes(spark):
    df = spark.createDataFrame([(1, None), (2, 2), (None, 3), (None, 4), (None, None)], "a int, `b.c` int")
    assert k.num_row(df) == 5 and k.num_unique_entries(df, "a") == 3 and k.num_unique_entries(df, ["a", "b.c"]) == 5
    assert [k.num_missing_entries(df, c) for c in ("a", "b.c", ["a", "b.c"])] == [3, 2, 5]
    assert k.num_missing_entries(df.where("false"), "a") == 0
    assert k.check_size(df, "==", 5) and k.assert_size(df, ">", 4) == 5
    with pytest.raises(AssertionError, match="5 rows, not < 5"):
        k.assert_size(df, "<", 5)
    assert k.check_size_comparison(df, ">", df.limit(2)) and k.assert_size_comparison(df, ">=", df) == (5, 5)
    with pytest.raises(AssertionError):
        k.assert_size_comparison(df, "<", df)
    assert k.check_num_distinct(df, "a", "==", 3) and k.assert_num_distinct(df, "a", "<", 4) == 3
    with pytest.raises(AssertionError, match="a, b.c"):
        k.assert_num_distinct(df, ["a", "b.c"], "==", 1)
    assert k.check_size_missing(df, "a", "==", 3) and k.assert_size_missing(df, "a", "<=", 3) == 3
    with pytest.raises(AssertionError):
        k.assert_size_missing(df, "a", "==", 0)
    with pytest.raises(ValueError):
        k.num_unique_entries(df, "zz")


def test_unique(spark):
    df = spark.createDataFrame(list(zip(range(1, 7), "ababcb")), "uu int, vv string")
    assert k.check_all_unique(df, "uu") and not k.check_all_unique(df, "vv") and k.check_all_unique(df, ["uu", "vv"])
    assert k.assert_all_unique(df, "uu") == 6
    with pytest.raises(AssertionError):
        k.assert_all_unique(df, "vv")
    assert not k.check_all_unique(spark.createDataFrame([(None,), (None,)], "a int"), "a")


def test_coverage(spark):
    a = spark.createDataFrame(list(zip([1, 2, 3, 4, 5], [1, 2, 3, 1, 2])), "a int, b int")
    b = spark.createDataFrame(list(zip([1, 2, 3, 4, 4], [3, 3, 2, 3, 2])), "a int, z int")
    assert k.check_join_covered(b, a, "a") and not k.check_join_covered(a, b, "a")
    with pytest.raises(AssertionError, match="1 rows"):
        k.assert_join_covered(a, b, "a")
    with pytest.raises(AssertionError, match="2 rows"):
        k.assert_join_covered(a, b, {"b": "z"})
    assert k.assert_join_covered(b, a, ["a"]) == 0
    assert not k.check_join_covered(spark.createDataFrame([(None,)], "a int"), spark.createDataFrame([(None,)], "a int"), "a")
    with pytest.raises(ValueError):
        k.check_join_covered(a, b, "zz")


def apart(rows):
    """The definition, pair by pair."""
    by = {}
    for g, s, e in rows:
        by.setdefault(g, []).append((s, e))
    for spells in by.values():
        if any(len({x[i] for x in spells}) < len(spells) for i in (0, 1)):
            return False
    for (g, s, e), (h, t, f) in itertools.permutations(rows, 2):
        if None not in (g, s, e, h, t, f) and g == h and s <= f and t <= e and s != t and e != f:
            return False
    return True


@pytest.mark.parametrize("seed", range(3))
def test_date_overlap_against_the_definition(spark, seed):
    rng = random.Random(seed)
    seen = set()
    for _ in range(25):
        rows = []
        for i in range(rng.randrange(1, 6)):
            s = None if rng.random() < 0.1 else D(2019, 12, 1) + dt.timedelta(rng.randrange(0, 60))
            e = None if s is None or rng.random() < 0.1 else s + dt.timedelta(rng.choice([0, 5, 30, -10]))
            rows.append((rng.choice([1, 2, None]) if rng.random() < 0.5 else 1, s, e))
        df = spark.createDataFrame([(*r, "x") for r in rows], "g int, s date, e date, y string")
        want = apart(rows)
        seen.add(want)
        assert k.check_no_date_overlap(df, "s", "e", "g") == want, rows
    assert seen == {True, False}


def test_date_overlap_groups(spark):
    rows = [(1, D(2020, 1, 1), D(2020, 2, 1)), (2, D(2020, 1, 15), D(2020, 2, 15))]
    df = spark.createDataFrame(rows, "id int, s date, e date")
    assert k.check_no_date_overlap(df, "s", "e", "id") and not k.check_no_date_overlap(df, "s", "e")
    touching = spark.createDataFrame([(1, D(2019, 12, 1), D(2020, 1, 1)), (1, D(2020, 1, 1), D(2020, 2, 1))], "id int, s date, e date")
    assert not k.check_no_date_overlap(touching, "s", "e", "id")
    assert k.check_no_date_overlap(df.where("false"), "s", "e", "id")


def test_clashing_groups(spark):
    day = lambda n: D(2020, 1, 1) + dt.timedelta(n)
    spells = {"apart": [(0, 5), (6, 9)], "over": [(0, 5), (5, 9)], "years": [(0, 500), (400, 450)], "start": [(0, 5), (0, 7)], "inverted": [(0, 9), (6, 3)], "end": [(0, 5), (3, 5)]}
    df = spark.createDataFrame([(g, day(a), day(b)) for g, x in spells.items() for a, b in x], "g string, s date, e date")
    got = {tuple(x) for x in k.clashing_groups(df, "s", "e", "g").collect()}
    assert got == {("over", "overlap"), ("years", "overlap"), ("start", "equal start"), ("inverted", "overlap"), ("end", "equal end"), ("end", "overlap")}


def test_the_sweep_is_a_query():
    assert "chk_clashing_groups" in entry.queries() and "chk_clashing_groups" in entry.oracle_sql()
