"""Counts and sums over many groupings, in one labelled format.

Columns: pairs col01, val01, col02, val02, ... with the names and values of the grouping columns, summarised_var with the
name of the summarised one, and any of distinct, count and sum.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import number_text, quoted

CLEAN = ("none", "na.as.zero", "zero.as.na")


def cross_product_column_names(*sets: list[str], always: list[str] | None = None, drop_dupes_within: bool = True, drop_dupes_across: bool = True) -> list[list[str]]:
    """All ways to take one name from each set, `always` in front. Within: a name once per combination; across: a combination,
    whatever its order, once."""
    out: list[list[str]] = []
    for picks in itertools.product(*sets):
        names = [*(always or []), *picks]
        out.append(list(dict.fromkeys(names)) if drop_dupes_within else names)
    if drop_dupes_across:
        out = [list(x) for x in dict.fromkeys(tuple(sorted(x)) for x in out)]
    return out


#: Columns of the format other than the numbered pairs.
_MEASURE = re.compile(r"(raw_|conf_)?(count|sum|distinct)")


def has_long_thin_format(df: DataFrame) -> bool:
    """Whether the columns are those of the format, in any order, with as many col as val columns and no others."""
    numbers: dict[str, set[str]] = {"col": set(), "val": set()}
    for c in df.columns:
        kind, number = c[:3], c[3:]
        if kind in numbers and len(number) == 2 and number.isascii() and number.isdigit():
            numbers[kind].add(number)
        elif c != "summarised_var" and not _MEASURE.fullmatch(c):
            return False
    return len(numbers["col"]) == len(numbers["val"])


def _cleaned(c: Column, clean: str) -> Column:
    if clean == "na.as.zero":
        return F.coalesce(c, F.lit(0))
    return F.nullif(c, F.lit(0)) if clean == "zero.as.na" else c


def _check(df: DataFrame, columns: list[str], make: tuple[bool, bool, bool], clean: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    if not any(make):
        raise ValueError("at least one of distinct, count and sum is needed")
    if clean not in CLEAN:
        raise ValueError(f"clean is one of {', '.join(CLEAN)}")


def _measures(value: Column, make: tuple[bool, bool, bool]) -> list[Column]:
    aggs = [F.count_distinct(value).alias("distinct"), F.count(value).alias("count"), F.sum(value).alias("sum")]
    return [a for a, wanted in zip(aggs, make) if wanted]


def _labels(df: DataFrame, group: list[str], value_of, summarised: str) -> list[Column]:
    cols = []
    for i, g in enumerate(group, 1):
        cols += [F.lit(g).alias(f"col{i:02d}"), number_text(value_of(g), df.schema[g].dataType).alias(f"val{i:02d}")]
    return [*cols, F.lit(summarised).alias("summarised_var")]


def summarise_and_label(
    df: DataFrame,
    group_by_cols: list[str],
    summarise_col: str,
    make_distinct: bool = False,
    make_count: bool = False,
    make_sum: bool = False,
    clean: str = "none",
    remove_na_from_groups: bool = True,
) -> DataFrame:
    """One grouping's summary. NULL values of the summarised column, after cleaning, are left out; so are rows with a NULL
    in a grouping column if asked."""
    make = (make_distinct, make_count, make_sum)
    _check(df, [*group_by_cols, summarise_col], make, clean)
    keys = [f"__g{i}" for i in range(len(group_by_cols))]
    rows = df.select(*[quoted(g).alias(k) for g, k in zip(group_by_cols, keys)], _cleaned(quoted(summarise_col), clean).alias("__v")).where("__v is not null")
    if remove_na_from_groups and keys:
        rows = rows.dropna(subset=keys)
    at = dict(zip(group_by_cols, keys))
    out = rows.groupBy(*keys).agg(*_measures(F.col("__v"), make))
    return out.select(*_labels(df, group_by_cols, lambda g: F.col(at[g]), summarise_col), *[c for c in out.columns if c not in keys])


def summarise_and_label_over_lists(
    df: DataFrame,
    group_by_list: list[list[str]],
    summarise_list: list[str],
    make_distinct: bool = False,
    make_count: bool = False,
    make_sum: bool = False,
    clean: str = "none",
    remove_na_from_groups: bool = True,
) -> DataFrame:
    """All groupings of all summarised columns, one below the other, by name; narrower groupings have NULL in the columns
    they lack. Each summarised column's groupings are one GROUPING SETS query: one scan and one shuffle, not one per pair."""
    make = (make_distinct, make_count, make_sum)
    if not group_by_list or not summarise_list:
        raise ValueError("at least one grouping and one summarised column are needed")
    group_by_list = [list(g) for g in group_by_list]
    names = list(dict.fromkeys(itertools.chain.from_iterable(group_by_list)))
    _check(df, [*names, *summarise_list], make, clean)
    keys = {n: f"__g{i}" for i, n in enumerate(names)}
    width = max(map(len, group_by_list))
    return reduce(DataFrame.unionByName, [_one(df, group_by_list, keys, s, make, clean, remove_na_from_groups, width) for s in summarise_list])


def _one(df: DataFrame, groups: list[list[str]], keys: dict[str, str], summarised: str, make, clean: str, remove_na: bool, width: int) -> DataFrame:
    rows = df.select(*[quoted(n).alias(k) for n, k in keys.items()], _cleaned(quoted(summarised), clean).alias("__v")).where("__v is not null")
    sets = [[F.col(keys[n]) for n in dict.fromkeys(g)] for g in groups]
    unique = {frozenset(keys[n] for n in g): s for g, s in zip(groups, sets)}  # an equal set in another order is the same rows
    out = rows.groupingSets(list(unique.values()), *[F.col(k) for k in keys.values()]).agg(F.grouping_id().alias("__id"), *_measures(F.col("__v"), make))
    measures = out.columns[len(keys) + 1 :]
    bits = list(keys.values())

    def id_of(g: list[str]) -> int:
        own = {keys[n] for n in g}
        return sum(1 << (len(bits) - 1 - i) for i, b in enumerate(bits) if b not in own)

    def labelled(g: list[str]) -> Column:
        fields = []
        for i in range(width):
            there = i < len(g)
            fields.append((F.lit(g[i]) if there else F.lit(None).cast("string")).alias(f"col{i + 1:02d}"))
            fields.append((number_text(F.col(keys[g[i]]), df.schema[g[i]].dataType) if there else F.lit(None).cast("string")).alias(f"val{i + 1:02d}"))
        whole = reduce(lambda a, b: a & b, [F.col(keys[n]).isNotNull() for n in g], F.lit(True)) if remove_na else F.lit(True)
        return F.when((F.col("__id") == id_of(g)) & whole, F.struct(*fields))

    found = out.select(F.explode(F.array_compact(F.array(*[labelled(g) for g in groups]))).alias("l"), *measures)
    return found.select("l.*", F.lit(summarised).alias("summarised_var"), *measures)
