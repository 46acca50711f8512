"""Samples for looking at, and a report of a table's columns."""

from __future__ import annotations

import datetime as dt
import html
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import quoted


def limited_rows(df: DataFrame, row_limit: int = 10_000, id_column: str | None = None) -> DataFrame:
    """At most row_limit rows. With an id column and more rows than that, ids divisible by ceil(rows / limit) first, so that
    all rows of an id stay together; rows with a NULL id are then left out."""
    if id_column is not None:
        n = df.count()
        if n > row_limit:
            df = df.where(quoted(id_column) % F.lit(-(-n // row_limit)) == 0)
    return df.limit(row_limit)


def profile_columns(df: DataFrame, top: int = 5) -> list[dict]:
    """Per column its type, rows, missing and different values, least, greatest and mean, and commonest values: one pass
    for the figures and two, over column and value pairs, for the number of different values, exactly, and the commonest.
    Values are told apart by their text, 0 and -0 being equal."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = quoted(f.name)
        aggs.append(F.count(c).alias(f"n{i}"))
        if isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.StringType)):
            aggs += [F.min(c).cast("string").alias(f"a{i}"), F.max(c).cast("string").alias(f"b{i}")]
        if isinstance(f.dataType, T.NumericType):
            aggs.append(F.avg(c).alias(f"m{i}"))
    row = df.agg(*aggs).first().asDict()
    plain = [F.when(quoted(f.name) == 0, F.lit("0.0")).otherwise(quoted(f.name).cast("string")) if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType) else quoted(f.name).cast("string") for f in df.schema.fields]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(plain)]))
    counts = df.select(pairs.alias("p")).select("p.i", "p.v").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    different = {r["i"]: r["count"] for r in counts.groupBy("i").count().collect()}
    first = Window.partitionBy("i").orderBy(F.desc("n"), "v")  # the limit is applied before the shuffle as well
    best = counts.withColumn("no", F.row_number().over(first)).where(F.col("no") <= top).collect()
    tops: dict[int, list[tuple[str, int]]] = {}
    for r in sorted(best, key=lambda r: r["no"]):
        tops.setdefault(r["i"], []).append((r["v"], r["n"]))
    return [
        {
            "column": f.name,
            "type": f.dataType.simpleString(),
            "rows": row["rows"],
            "missing": row["rows"] - row[f"n{i}"],
            "distinct": different.get(i, 0),
            "min": row.get(f"a{i}"),
            "max": row.get(f"b{i}"),
            "mean": row.get(f"m{i}"),
            "top": tops.get(i, []),
        }
        for i, f in enumerate(df.schema.fields)
    ]


def explore_report(df: DataFrame, id_column: str | None = None, target: str | None = None, output_file: str = "df explored", output_dir: str = ".", row_limit: int = 10_000) -> str:
    """An HTML report on at most row_limit rows: a table of the columns and, with a target, the numbers' means by its values,
    all of them: at most as many as rows.

    Returns the file's name, '<time> <name>.html'.
    """
    some = limited_rows(df, row_limit, id_column).drop(*([id_column] if id_column else [])).cache()
    try:
        rows = profile_columns(some)
        parts = [pd.DataFrame(rows).assign(top=lambda d: [", ".join(f"{v} ({n})" for v, n in t) for t in d["top"]]).to_html(index=False)]
        if target is not None:
            numbers = [f.name for f in some.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != target]
            by = some.groupBy(quoted(target)).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(quoted(c)).alias(f"mean {c}") for c in numbers])
            parts += [f"<h2>By {html.escape(target)}</h2>", by.orderBy(F.desc("rows"), quoted(target)).toPandas().to_html(index=False)]
    finally:
        some.unpersist()
    name = f"{dt.datetime.now():%Y-%m-%d %H%M%S} {output_file}.html"
    Path(output_dir).mkdir(parents=True, exist_ok=True)
    Path(output_dir, name).write_text(f"<html><head><title>{html.escape(output_file)}</title></head><body>" + "\n".join(parts) + "</body></html>")
    return name
