"""Checks of a table: check_* answers True or False, assert_* raises with the figures and returns them."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import quoted

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compare(value: float, direction: str, bound: float) -> bool:
    """`value direction bound`; both must be numbers."""
    if direction not in COMPARE:
        raise ValueError(f"direction {direction!r} is not one of {' '.join(COMPARE)}")
    for x in (value, bound):
        if isinstance(x, bool) or not isinstance(x, (int, float)) or x != x:
            raise TypeError(f"{x!r} is not a number")
    return COMPARE[direction](value, bound)


def _columns(df: DataFrame, columns: list[str] | str) -> list[str]:
    columns = [columns] if isinstance(columns, str) else list(columns)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    return columns


def num_row(df: DataFrame) -> int:
    return df.count()


def num_unique_entries(df: DataFrame, columns: list[str] | str) -> int:
    """Different combinations, NULL being a value."""
    return df.select(*map(quoted, _columns(df, columns))).distinct().count()


def num_missing_entries(df: DataFrame, columns: list[str] | str) -> int:
    """NULLs summed over the columns, in one pass; 0 for an empty table."""
    total = sum((F.coalesce(F.sum(quoted(c).isNull().cast("bigint")), F.lit(0)) for c in _columns(df, columns)), F.lit(0))
    return df.agg(total.alias("n")).first()[0]


def check_size(df: DataFrame, direction: str, size: float) -> bool:
    return compare(num_row(df), direction, size)


def assert_size(df: DataFrame, direction: str, size: float) -> int:
    n = num_row(df)
    if not compare(n, direction, size):
        raise AssertionError(f"table has {n} rows, not {direction} {size}")
    return n


def check_size_comparison(a: DataFrame, direction: str, b: DataFrame) -> bool:
    return compare(num_row(a), direction, num_row(b))


def assert_size_comparison(a: DataFrame, direction: str, b: DataFrame) -> tuple[int, int]:
    n, m = num_row(a), num_row(b)
    if not compare(n, direction, m):
        raise AssertionError(f"first table has {n} rows, not {direction} the {m} of the second")
    return n, m


def check_num_distinct(df: DataFrame, columns: list[str] | str, direction: str, number: float) -> bool:
    return compare(num_unique_entries(df, columns), direction, number)


def assert_num_distinct(df: DataFrame, columns: list[str] | str, direction: str, number: float) -> int:
    n = num_unique_entries(df, columns)
    if not compare(n, direction, number):
        raise AssertionError(f"{n} distinct entries in {', '.join(_columns(df, columns))}, not {direction} {number}")
    return n


def _repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*map(quoted, columns)).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")


def check_all_unique(df: DataFrame, columns: list[str] | str) -> bool:
    """Whether no combination occurs twice; one grouping, NULLs being equal."""
    return _repeated(df, _columns(df, columns)).isEmpty()


def assert_all_unique(df: DataFrame, columns: list[str] | str) -> int:
    columns = _columns(df, columns)
    n, unique = num_row(df), num_unique_entries(df, columns)
    if n != unique:
        raise AssertionError(f"{unique} distinct entries in {', '.join(columns)} for {n} rows")
    return n


def check_size_missing(df: DataFrame, columns: list[str] | str, direction: str, number: float) -> bool:
    return compare(num_missing_entries(df, columns), direction, number)


def assert_size_missing(df: DataFrame, columns: list[str] | str, direction: str, number: float) -> int:
    n = num_missing_entries(df, columns)
    if not compare(n, direction, number):
        raise AssertionError(f"{n} missing entries in {', '.join(_columns(df, columns))}, not {direction} {number}")
    return n


def uncovered(a: DataFrame, b: DataFrame, on: dict[str, str] | list[str] | str) -> DataFrame:
    """Rows of a without a partner in b; on names equal columns, or maps a's to b's. NULL keys have no partner."""
    pairs = on if isinstance(on, dict) else {c: c for c in ([on] if isinstance(on, str) else on)}
    _columns(a, list(pairs)), _columns(b, list(pairs.values()))
    right = b.select(*[quoted(y).alias(f"__key{i}") for i, y in enumerate(pairs.values())])
    left = a.select("*", *[quoted(x).alias(f"__left{i}") for i, x in enumerate(pairs)])
    cond = [F.col(f"__left{i}") == F.col(f"__key{i}") for i in range(len(pairs))]
    return left.join(right, cond, "left_anti").drop(*[f"__left{i}" for i in range(len(pairs))])


def check_join_covered(a: DataFrame, b: DataFrame, on: dict[str, str] | list[str] | str) -> bool:
    return uncovered(a, b, on).isEmpty()


def assert_join_covered(a: DataFrame, b: DataFrame, on: dict[str, str] | list[str] | str) -> int:
    n = uncovered(a, b, on).count()
    if n:
        raise AssertionError(f"{n} rows of the first table have no match in the second")
    return n


def _clashes(df: DataFrame, start: str, end: str, group_by: list[str] | str) -> list[DataFrame]:
    """Two steps of looking for clashes, the cheaper first; the parts of a step share their shuffles."""
    group_by = _columns(df, group_by)
    _columns(df, [start, end])
    s = df.select(*[quoted(g).alias(f"g{i}") for i, g in enumerate(group_by)], quoted(start).alias("s"), quoted(end).alias("e"))
    keys = [f"g{i}" for i in range(len(group_by))]
    kind = lambda d, k: d.select(*keys, F.lit(k).alias("clash"))
    equal = [kind(_repeated(s, [*keys, c]), f"equal {'start' if c == 's' else 'end'}") for c in ("s", "e")]
    whole = s.dropna()
    # only a spell that begins on or before another's end clashes; with no inverted spell the furthest end so far decides:
    # inside each year of starts first, where a group has at most one row a day, then from year to year
    starts = whole.where("e >= s").groupBy(*keys, F.year("s").alias("y"), "s").agg(F.max("e").alias("e"))
    before = Window.partitionBy(*keys, "y").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    over = kind(starts.withColumn("reach", F.max("e").over(before)).where("reach >= s"), "overlap")
    years = starts.groupBy(*keys, "y").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    before = Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    over = [over, kind(years.withColumn("reach", F.max("e").over(before)).where("reach >= s"), "overlap")]
    # a spell that ends before it starts clashes with those that hold both its days, and never with its like: the furthest
    # end of the spells begun by its own end has to reach its start
    asked = whole.where("e < s").groupBy(*keys, F.year("e").alias("y"), F.col("e").alias("at")).agg(F.min("s").alias("need"))
    both = starts.withColumnRenamed("s", "at").unionByName(asked, allowMissingColumns=True)
    begun = Window.partitionBy(*keys, "y").orderBy("at", F.col("need").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    inverted = kind(both.withColumn("reach", F.max("e").over(begun)).where("reach >= need"), "overlap")
    years = both.groupBy(*keys, "y").agg(F.max("e").alias("e"), F.min("need").alias("need"))
    inverted = [inverted, kind(years.withColumn("reach", F.max("e").over(before)).where("reach >= need"), "overlap")]
    return [reduce(DataFrame.unionByName, x) for x in (equal, [*over, *inverted])]


def date_overlaps(df: DataFrame, start: str, end: str, group_by: list[str] | str = ()) -> DataFrame:
    """A row per kind of clash found in the spells of each group: equal starts, equal ends, or overlapping spells."""
    return reduce(DataFrame.unionByName, _clashes(df, start, end, group_by)).select("clash")


def clashing_groups(df: DataFrame, start: str, end: str, group_by: list[str] | str) -> DataFrame:
    """group_by, clash: each group with each kind of clash found in its spells, once. Two spells
    that start on the same day are an equal start and no overlap; as in date_overlaps(), spells with a NULL overlap nothing."""
    found = reduce(DataFrame.unionByName, _clashes(df, start, end, group_by)).distinct()
    return found.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(_columns(df, group_by))], "clash")


def check_no_date_overlap(df: DataFrame, start: str, end: str, group_by: list[str] | str = ()) -> bool:
    """Whether no two spells of a group share a start, an end, or a day; both end days count.

    NULLs are equal when starts and ends are compared, and overlap nothing. The spells are swept in order of their start,
    and no pairs of them are formed, also where a spell ends before it starts. Clashes found in the first step end the search.
    """
    return all(c.isEmpty() for c in _clashes(df, start, end, group_by))
