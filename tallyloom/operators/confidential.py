"""Random and graduated rounding, suppression of small counts, and both together on summaries."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import label_uniform, quoted
from tallyloom.operators.summarise import has_long_thin_format
from tallyloom.session import write_shared

#: Bases of graduated rounding: (from, up to but without, base) of the absolute value (fixed values).
GRADES = [(0, 19, 3), (19, 20, 2), (20, 100, 5), (100, 1000, 10), (1000, None, 100)]


def graduated_base(x: Column) -> Column:
    """The base that a value's size calls for."""
    size, out = F.abs(x), None
    for _, to, base in GRADES[:-1]:
        out = F.when(size < to, F.lit(base)) if out is None else out.when(size < to, F.lit(base))
    return F.when(x.isNotNull(), out.otherwise(F.lit(GRADES[-1][2])))


def randomly_rounded(x: Column, base: Column | int, u: Column) -> Column:
    """x down or up to a multiple of base, so that its expectation is x: down if u, uniform on [0, 1), is below (base - r) / base
    with r the remainder, from 0 to base. Multiples stay, NULL stays NULL."""
    base = F.lit(base) if isinstance(base, int) else base
    r = F.pmod(x, base)
    return F.when(r == 0, x).otherwise(x - r + F.when(u < (base - r).cast("double") / base, F.lit(0)).otherwise(base))


def round_values(values: list[float | None], base: int = 3, uniforms: list[float] | None = None) -> list[float | None]:
    """The same of a few local values, with a uniform number for each, or fresh ones."""
    uniforms = [random.random() for _ in values] if uniforms is None else uniforms
    if len(uniforms) != len(values):
        raise ValueError("a uniform number is needed for each value")

    def one(x: float | None, u: float) -> float | None:
        r = None if x is None or x != x else x % base
        return x if not r else x - r if u < (base - r) / base else x - r + base

    return [one(x, u) for x, u in zip(values, uniforms)]


def _rounded(df: DataFrame, columns: list[str], base_of, stable: list[str] | None) -> DataFrame:
    if missing := [c for c in [*columns, *(stable or [])] if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    if stable and set(stable) & set(columns):
        raise ValueError("columns to round cannot be the labels that keep rounding stable")
    raw = df.select(*[quoted(c).alias(f"raw_{c}") if c in columns else quoted(c) for c in df.columns])
    u = label_uniform([quoted(c) for c in stable]) if stable else None
    new = [randomly_rounded(quoted(f"raw_{c}"), base_of(quoted(f"raw_{c}")), F.rand() if u is None else u).alias(f"conf_{c}") for c in columns]
    return raw.select("*", *new)


def apply_random_rounding(df: DataFrame, columns: list[str], base: int = 3, stable_across: list[str] | None = None) -> DataFrame:
    """Each column is renamed raw_*, and its rounded values added as conf_*.

    With stable_across the rounding depends on the labels in these columns only: equal labels, in whatever order, round
    alike in every run and in every column. Without it each value is rounded at random, anew whenever the result is
    computed: write it before using it twice.
    """
    if base < 1:
        raise ValueError("base must be 1 or more")
    return _rounded(df, columns, lambda x: F.lit(base), stable_across)


def apply_graduated_random_rounding(df: DataFrame, columns: list[str], stable_across: list[str] | None = None) -> DataFrame:
    """apply_random_rounding with the base growing with the value (GRADES)."""
    return _rounded(df, columns, graduated_base, stable_across)


def apply_small_count_suppression(df: DataFrame, suppress_cols: list[str], threshold: float | list[float], count_cols: list[str] | None = None) -> DataFrame:
    """Rows in which any count is below its threshold get NULL in all suppress_cols; a NULL count suppresses nothing."""
    count_cols = list(suppress_cols) if count_cols is None else list(count_cols)
    if missing := [c for c in [*suppress_cols, *count_cols] if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    limits = list(threshold) if isinstance(threshold, (list, tuple)) else [threshold] * len(count_cols)
    if len(limits) != len(count_cols):
        raise ValueError("one threshold, or one for each count column")
    low = reduce(lambda a, b: a | b, [F.coalesce(quoted(c) < t, F.lit(False)) for c, t in zip(count_cols, limits)])
    return df.select(*[F.when(~low, quoted(c)).alias(c) if c in suppress_cols else quoted(c) for c in df.columns])


def confidentialise_results(df: DataFrame, stable_rr: bool = False, sum_rr: bool = False, base: int = 3, count_threshold: float = 6, sum_threshold: float = 20) -> DataFrame:
    """A summary in long-thin format made fit for release.

    distinct and count (and sum, if asked) are rounded at random; rounded counts are NULL where any raw count is below
    count_threshold, and sums where any is below sum_threshold. If there are sums, rounded counts are then moved by base
    where rounding took them across sum_threshold, so that they agree with which sums are suppressed.
    """
    if not has_long_thin_format(df):
        raise ValueError("the table is not in long-thin format")
    counts = [c for c in ("distinct", "count") if c in df.columns]
    if not counts:
        raise ValueError("a column distinct or count is needed")
    has_sum = "sum" in df.columns
    labels = [c for c in df.columns if c.startswith(("col", "val")) and c[3:].isdigit() or c == "summarised_var"]
    out = apply_random_rounding(df, counts + (["sum"] if has_sum and sum_rr else []), base, labels if stable_rr else None)
    raw, conf = [f"raw_{c}" for c in counts], [f"conf_{c}" for c in counts]
    if not stable_rr:  # one draw, used below several times
        out = write_shared(out, "rounded")
    out = apply_small_count_suppression(out, conf, count_threshold, raw)
    if has_sum:
        if not sum_rr:
            out = out.select(*[quoted(c).alias("raw_sum") if c == "sum" else quoted(c) for c in out.columns], F.col("sum").alias("conf_sum"))
        out = apply_small_count_suppression(out, ["conf_sum"], sum_threshold, raw)
        for r, c in zip(raw, conf):
            over = (quoted(r) < sum_threshold) & (quoted(c) >= sum_threshold)
            under = (quoted(r) >= sum_threshold) & (quoted(c) < sum_threshold)
            out = out.withColumn(c, F.when(over, quoted(c) - base).when(under, quoted(c) + base).otherwise(quoted(c)))
    return out
