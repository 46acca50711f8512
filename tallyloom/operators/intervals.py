"""Overlapping, nested and scattered spells of an entity as continuous periods and the gaps between them.

Spark's session_window with a length per row merges overlapping spells natively; touching periods are joined after it and
gaps read off with lead.

Scale: an entity may hold a third of all rows. Spells are first reduced to one per entity and start day (map-side), then
merged inside each calendar year of the start, where at most 366 rows can meet, and only the disjoint partial periods of
the years meet per entity: at most 183 a year, however many spells there were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_spells(df: DataFrame, entity: str, start: str, end: str, open_end: str = "9999-12-31") -> DataFrame:
    """entity, start, end as dates. Rows without entity or start, or ending before they start, cover nothing and are left
    out; a NULL end becomes open_end."""
    return df.select(
        F.col(entity).alias("entity"),
        F.col(start).cast("date").alias("start"),
        F.coalesce(F.col(end).cast("date"), F.lit(open_end).cast("date")).alias("end"),
    ).where("entity is not null and start is not null and end >= start")


def continuous_periods(df: DataFrame, entity: str, start: str, end: str, open_end: str = "9999-12-31") -> DataFrame:
    """entity, first_day, last_day, spells: each longest stretch of days without an uncovered day.

    Both end days of a spell count; spells whose days follow each other without a gap belong together. spells is the
    number of spells in the period that differ in start or end; repeated rows count once. Times of day are cut off. See
    clean_spells for what is left out. An empty table gives no periods.
    """
    starts = (
        clean_spells(df, entity, start, end, open_end)
        .groupBy("entity", "start")
        .agg(F.max("end").alias("end"), F.count_distinct("end").alias("spells"))
    )
    by_year = (
        starts.select(
            "entity",
            F.year("start").alias("year"),
            F.col("start").cast("timestamp_ntz").alias("at"),
            F.make_interval(days=F.datediff("end", "start") + 1).alias("length"),
            "spells",
        )
        .groupBy("entity", "year", F.session_window("at", F.col("length")).alias("w"))
        .agg(F.sum("spells").alias("spells"))
    )
    merged = (
        by_year.select(
            "entity",
            F.col("w.start").alias("at"),
            F.make_interval(days=F.datediff(F.col("w.end").cast("date"), F.col("w.start").cast("date"))).alias("length"),
            "spells",
        )
        .groupBy("entity", F.session_window("at", F.col("length")).alias("w"))
        .agg(F.sum("spells").alias("spells"))
        .select(
            "entity",
            F.col("w.start").cast("date").alias("first_day"),
            F.date_sub(F.col("w.end").cast("date"), 1).alias("last_day"),
            "spells",
        )
    )
    order = Window.partitionBy("entity").orderBy("first_day")
    new = F.coalesce(F.datediff("first_day", F.lag("last_day").over(order)) > 1, F.lit(True))
    return (
        merged.withColumn("new", new.cast("int"))
        .withColumn("no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("entity", "no")
        .agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("spells").alias("spells"))
        .select("entity", "first_day", "last_day", "spells")
    )


def periods_and_gaps(periods: DataFrame) -> DataFrame:
    """entity, kind, first_day, last_day, spells: the periods and, as kind 'gap' with 0 spells, the days between neighbours."""
    nxt = F.lead("first_day").over(Window.partitionBy("entity").orderBy("first_day"))
    both = periods.withColumn("nxt", nxt).select(
        "entity",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("period").alias("kind"), "first_day", "last_day", "spells"),
                    F.when(
                        F.col("nxt").isNotNull(),
                        F.struct(
                            F.lit("gap").alias("kind"),
                            F.date_add("last_day", 1).alias("first_day"),
                            F.date_sub("nxt", 1).alias("last_day"),
                            F.lit(0).cast("bigint").alias("spells"),
                        ),
                    ),
                )
            )
        ).alias("x"),
    )
    return both.select("entity", "x.*")
