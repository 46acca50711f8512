"""Union, pivot and indicator columns."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import quoted
from tallyloom.sources.catalog import check_case_clashes

AGGREGATES = ("sum", "min", "max", "avg", "mean", "count")
MOST_LABELS = 20_000


def _need(df: DataFrame, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")


def union_all(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns of both tables, in order, duplicates kept."""
    if not columns:
        raise ValueError("at least one column is needed")
    _need(a, columns), _need(b, columns)
    return a.select(*map(quoted, columns)).unionByName(b.select(*map(quoted, columns)))


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Tables one below the other, columns by name; columns that a table lacks are NULL in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_labels(df: DataFrame, label: str) -> list[str]:
    """Sorted different labels, NULL left out: they become columns, so more than MOST_LABELS are an error."""
    rows = df.select(quoted(label).cast("string")).where(quoted(label).isNotNull()).distinct().limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different labels: not columns of a table")
    return sorted(r[0] for r in rows)


def pivot_table(df: DataFrame, label: str, value: str, aggregator: str | Callable[[Column], Column] = "sum", fill: float | None = 0, labels: list[str] | None = None) -> DataFrame:
    """One row per combination of all other columns, one column per label, in order of the labels.

    A column aggregates the value of rows with its label and `fill` for rows with another, so absent combinations give 0
    (and with min, max, avg or count the 0 takes part). Rows without a label keep their group but count in no column.
    Labels, unless given, are found by a query of their own.

    A named aggregate goes by cells, whatever the number of labels: rows are reduced to a cell per group and label before
    the shuffle, and what fill adds to a cell follows from the number of the group's other rows. A function of one's own
    can only be applied per label to all rows of a group, which is for a few hundred labels at most.
    """
    _need(df, [label, value])
    labels = distinct_labels(df, label) if labels is None else labels
    keys = [c for c in df.columns if c not in (label, value)]
    check_case_clashes([*keys, *labels])
    lab, val = quoted(label).cast("string"), quoted(value)
    if isinstance(aggregator, str):
        if aggregator not in AGGREGATES:
            raise ValueError(f"aggregator is one of {', '.join(AGGREGATES)}, or a function")
        return _by_cells(df, keys, lab, val, aggregator, fill, labels)
    cells = []
    for x in labels:
        cell = F.when(lab == x, val)
        cells.append(aggregator(cell if fill is None else cell.when(lab != x, F.lit(fill))).alias(x))
    return df.groupBy(*map(quoted, keys)).agg(*cells)


def _by_cells(df: DataFrame, keys: list[str], lab: Column, val: Column, aggregator: str, fill: float | None, labels: list[str]) -> DataFrame:
    parts = {
        "sum": [F.sum("__value").alias("sum")],
        "min": [F.min("__value").alias("min")],
        "max": [F.max("__value").alias("max")],
        "avg": [F.sum(F.col("__value").cast("double")).alias("sum"), F.count("__value").alias("n")],
        "count": [F.count("__value").alias("n")],
    }
    name = "avg" if aggregator == "mean" else aggregator
    by = [*map(quoted, keys)]
    rows = df.select(*by, lab.alias("__label"), val.alias("__value"))
    cells = rows.groupBy(*by, "__label").agg(F.count(F.lit(1)).alias("__rows"), *[p.alias(f"__{i}") for i, p in enumerate(parts[name])])
    cell = F.struct(F.col("__rows").alias("rows"), *[F.col(f"__{i}").alias(("sum", "n")[i] if name == "avg" else "x") for i in range(len(parts[name]))])
    entry = F.when(F.col("__label").isNotNull(), F.struct(F.col("__label"), cell))
    wide = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("__cells"), F.coalesce(F.sum(F.when(F.col("__label").isNotNull(), F.col("__rows"))), F.lit(0)).alias("__all"))

    number = "0" if not fill else repr(fill) + ("D" if isinstance(fill, float) else "")

    def column(label: str) -> str:  # as text: thousands of columns are parsed much faster than built call by call
        text = label.replace("\\", "\\\\").replace("'", "\\'")
        c = f"__cells['{text}']"
        others = f"(__all - coalesce({c}.rows, 0L))" if fill is not None else "0L"
        if name == "count":
            return f"coalesce({c}.x, 0L) + {others}"
        if name == "avg":
            return f"try_divide(coalesce({c}.sum, 0D) + {others} * {number}, coalesce({c}.n, 0L) + {others})"
        if fill is None:
            return f"{c}.x"
        more = f" + {others} * {number}" if fill else ""
        filled = {"sum": f"coalesce({c}.x, 0){more}", "min": f"least({c}.x, {number})", "max": f"greatest({c}.x, {number})"}[name]
        return f"CASE WHEN {others} > 0 THEN {filled} ELSE {c}.x END"

    tick = lambda x: "`" + x.replace("`", "``") + "`"
    return wide.selectExpr(*map(tick, keys), *[f"{column(x)} AS {tick(x)}" for x in labels])


def collapse_indicator_columns(df: DataFrame, prefix: str, yes_values: list, label: str | None = None) -> DataFrame:
    """Indicator columns whose names begin with prefix (a pattern) as one column: the rest of the first one's name, in
    sorted order, that holds a yes value; NULL if none does. Without such columns df is unchanged, with a warning."""
    pattern = re.compile(f"^(?:{prefix})")
    found = sorted(c for c in df.columns if pattern.search(c))
    if not found:
        warnings.warn(f"no column begins with {prefix!r}", stacklevel=2)
        return df
    picks = [F.when(quoted(c).isin(list(yes_values)), F.lit(pattern.sub("", c, count=1))) for c in found]
    rest = [quoted(c) for c in df.columns if c not in found]
    return df.select(*rest, F.coalesce(*picks).alias(label or prefix))
