"""One feature row per entity from an event table, through a store of cumulative counts and totals.

The store holds, per entity, type and day, the running number of events, of different days and the running total of an
amount. Any window's features are then a subtraction of two as-of endpoints: what had accrued by the window's last day
less what had accrued before its first. Recency is the greatest day inside the window. A new window needs no new pass
over the events, and new events are appended to a kept store as a segment of their own (FeatureStore): endpoints of
segments add up, so late events of long past days change nothing that is stored.

Totals survive the subtraction: NaN and infinite amounts are running counts apart from the finite total, so one outside a
window leaves the window's total alone, and finite amounts are summed in lanes of unlike size (LANES), so that 5.0 is not
lost beside 1e17. Lanes below 2^68 are exact as long as their sums stay below 2^68, for amounts that are multiples of
2^-6 or so; beyond that a total is off by some units in the last place of the largest amounts.

Scale: events are pre-aggregated to entity x type x day before they are shuffled, so the largest group a window sorts
holds one row per calendar day, however hot an entity or a type is; one exchange by entity serves the running sums, the
endpoints and the entity's row.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import quoted
from tallyloom.sources.segments import SEGMENT, Segments

#: Place of undated events in a store: before every day.
UNDATED = -(2**31)
#: An amount is the sum of its lanes: what is a multiple of the first, of the rest what is one of the second, and the rest.
LANES = (2.0**68, 2.0**16)
#: Running counts, none of which ever falls, and running totals.
COUNTS = ("n", "days", "amounts", "nan", "up", "down")
TOTALS = ("high", "middle", "low")

Span = tuple[dt.date | str | None, dt.date | str | None]


def daily(events: DataFrame, entity: str, type_: str | None, day: str, amount: str | None = None, type_value: int | str | None = None) -> DataFrame:
    """entity, type, day_no and what a day's events add to each running figure; one row per entity, type and day with events."""
    x = F.col("x")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rest = x % F.lit(LANES[0])
    lanes = (x - rest, rest - rest % F.lit(LANES[1]), rest % F.lit(LANES[1]))
    c = events.where(quoted(entity).isNotNull()).select(
        quoted(entity).alias("entity"),
        (quoted(type_) if type_ else F.lit(type_value)).alias("type"),
        F.coalesce(F.unix_date(quoted(day).cast("date")), F.lit(UNDATED)).alias("day_no"),
        *([quoted(amount).cast("double").alias("x")] if amount else []),
    )
    figures = [F.count(F.lit(1)).alias("n")]
    if amount:
        figures += [F.count("x").alias("amounts"), F.count_if(F.isnan("x")).alias("nan")]
        figures += [F.count_if(x == float("inf")).alias("up"), F.count_if(x == float("-inf")).alias("down")]
        figures += [F.sum(F.when(finite, lane).otherwise(F.lit(0.0))).alias(t) for t, lane in zip(TOTALS, lanes)]
    out = c.groupBy("entity", "type", "day_no").agg(*figures)
    if not amount:
        out = out.select("*", *[F.lit(0).cast("bigint").alias(k) for k in COUNTS[2:]], *[F.lit(0.0).alias(k) for k in TOTALS])
    return out.withColumn("days", (F.col("day_no") > UNDATED).cast("bigint"))


def cumulated(days: DataFrame, partitions: int | None = None) -> DataFrame:
    """entity, type, day_no and cum_ columns: the running figures of daily rows. The rows lie in partitions by entity."""
    up_to = Window.partitionBy("entity", "type").orderBy("day_no").rowsBetween(Window.unboundedPreceding, 0)
    together = days.repartition(*([partitions] if partitions else []), "entity")
    return together.select("entity", "type", "day_no", *[F.sum(k).over(up_to).alias(f"cum_{k}") for k in (*COUNTS, *TOTALS)])


def cumulative_store(
    events: DataFrame, entity: str, type_: str | None, day: str, amount: str | None = None, type_value: int | str | None = None
) -> DataFrame:
    """Columns entity, type, day_no and the running figures (COUNTS and TOTALS, as cum_...), one row per entity, type and day
    with events.

    type_: the column with the event's type, or None if type_value is the type of all events. Rows without entity belong
    to nobody and are left out. A NULL type is a type of its own. A NULL day counts from before every window: it is part
    of all-time features and of no bounded window, and is not a day. NULL amounts count as events but add nothing; NaN
    and infinite ones make the totals of the windows they lie in NaN or infinite, and of no others. Repeated rows are
    repeated events. An empty table gives an empty store.
    """
    return cumulated(daily(events, entity, type_, day, amount, type_value))


class FeatureStore:
    """A store kept in a folder and extended by appending, bucketed by entity. A segment holds one append's running figures;
    of a day that an earlier segment has, days is not counted again. Appends are made one after the other."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None) -> None:
        self.segments = Segments(spark, folder, ["entity"], buckets)

    def append(self, days: DataFrame, no: int | None = None) -> int:
        """Add daily() rows of new events, as segment no if given: appending a number again replaces it, as long as it is the
        latest. The events' days may lie anywhere. The stored rows are read by bucket and not shuffled."""
        have = [r for r in self.segments.ranges() if no is None or r[1] < no]
        known, buckets = self.segments.read(have) if have else None, self.segments.buckets
        if known is not None:
            keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if k == "type" else F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("entity", "type", "day_no")]
            a = days.repartition(buckets, "entity").alias("a")
            b = known.select("entity", "type", "day_no").distinct().withColumn("old", F.lit(1)).alias("b")
            rest = [F.col(f"a.{c}") for c in days.columns if c != "days"]
            days = a.join(b, reduce(lambda p, q: p & q, keys), "left").select(*rest, F.when(F.col("b.old").isNull(), F.col("a.days")).otherwise(F.lit(0)).alias("days"))
        return self.segments.write(cumulated(days, buckets), no)

    def read(self) -> DataFrame | None:
        """The whole store, for asof_features(); None if nothing was appended."""
        return self.segments.read()


def asof_features(store: DataFrame, spans: dict[str, Span]) -> DataFrame:
    """Per entity and type, for each named span, a struct (n, days, last_day, total) of the events from its first to its last day.

    Either end of a span may be None, for no limit; only a span without a first day holds undated events. total is NULL
    where the span has no amount. Entities and types with no event in any span still come out, with zeros.
    """
    at = F.col("day_no")
    by = ["entity", "type"]
    segmented = [SEGMENT] if SEGMENT in store.columns else []
    ends: list[Column] = []
    for k, (first, last) in spans.items():
        lo = F.unix_date(F.lit(first).cast("date")) if first is not None else None
        hi = F.unix_date(F.lit(last).cast("date")) if last is not None else None
        by_last = at <= hi if hi is not None else F.lit(True)
        for side, there in (("hi", by_last), *([("lo", at < lo)] if lo is not None else [])):
            ends += [F.max(F.when(there, F.col(f"cum_{c}"))).alias(f"{k}_{side}_{c}") for c in COUNTS]
            ends += [F.max_by(F.when(there, F.col(f"cum_{t}")), F.when(there, at)).alias(f"{k}_{side}_{t}") for t in TOTALS]
        inside = by_last & (at >= lo if lo is not None else F.lit(True)) & (at > UNDATED)
        ends.append(F.max(F.when(inside, at)).alias(f"{k}_at"))

    def less(k: str, f: str) -> Column:
        hi = F.coalesce(F.col(f"{k}_hi_{f}"), F.lit(0))
        return hi - F.coalesce(F.col(f"{k}_lo_{f}"), F.lit(0)) if spans[k][0] is not None else hi

    found = store.groupBy(*by, *segmented).agg(*ends)
    parts = found.select(*by, *[less(k, f).alias(f"{k}_{f}") for k in spans for f in (*COUNTS, *TOTALS)], *[f"{k}_at" for k in spans])
    if segmented:
        parts = parts.groupBy(*by).agg(
            *[F.sum(f"{k}_{f}").alias(f"{k}_{f}") for k in spans for f in (*COUNTS, *TOTALS)], *[F.max(f"{k}_at").alias(f"{k}_at") for k in spans]
        )

    def total(k: str) -> Column:
        c = lambda f: F.col(f"{k}_{f}")
        odd = F.when((c("nan") > 0) | ((c("up") > 0) & (c("down") > 0)), float("nan")).when(c("up") > 0, float("inf")).when(c("down") > 0, float("-inf"))
        return F.when(c("amounts") > 0, F.coalesce(odd, c("high") + (c("middle") + c("low"))))

    out = [F.struct(F.col(f"{k}_n").alias("n"), F.col(f"{k}_days").alias("days"), F.date_from_unix_date(f"{k}_at").alias("last_day"), total(k).alias("total")).alias(k) for k in spans]
    return parts.select(*by, *out)


def entity_rows(features: DataFrame, spans: list[str]) -> DataFrame:
    """One row per entity: by_type, a map from type to its spans' structs, and untyped, the same of the NULL type.

    A row's map is bounded by the number of types.
    """
    s = F.struct(*spans)
    return features.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", s)))).alias("by_type"),
        F.first(F.when(F.col("type").isNull(), s), ignorenulls=True).alias("untyped"),
    )


def wide_features(rows: DataFrame, span: str, types: list[int | str], prefix: str = "c", keep: list[Column] | None = None) -> DataFrame:
    """Map rows as columns <prefix><type>_n and <prefix><type>_last for each listed type; 0 and NULL where there is none."""
    cols: list[str] = []
    for t in types:  # as text: hundreds of columns are parsed much faster than built call by call
        key = "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(t, str) else str(t)
        cols += [f"coalesce(__n[{key}], 0) AS `{prefix}{t}_n`", f"__last[{key}] AS `{prefix}{t}_last`"]
    part = lambda f: F.transform_values("by_type", lambda _, s: s[span][f])
    ready = rows.select("entity", *(keep or []), part("n").alias("__n"), part("last_day").alias("__last"))
    return ready.selectExpr(*[f"`{c}`" for c in ready.columns[:-2]], *cols)
