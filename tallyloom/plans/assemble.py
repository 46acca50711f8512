"""Cohort assembly: population periods joined to measure spells, summarised nine ways, as a long-thin and a wide table.

All population rows are one table of members and periods. Measures on the same table, identity and spell dates share one
join with it and one grouping: a joined row counts once for all measures with a literal label and once for each whose label
comes from a column or is a histogram's, by that label. Partial results are formed in the tasks of the join, before
anything is shuffled again.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import number_text, quoted
from tallyloom.names import inform
from tallyloom.operators.checks import check_all_unique
from tallyloom.operators.reshape import pivot_table
from tallyloom.plans import control
from tallyloom.plans.control import Cell, MeasureRow, PopulationRow
from tallyloom.sources import catalog

FIELDS = ["identity_column", "label_identity", "summary_period_start_date", "summary_period_end_date", "label_summary_period"]
DEVELOPMENT_ROWS = 1000
IGNORES_PROPORTION = ("COUNT", "EXISTS", "DISTINCT", "HISTOGRAM")


@dataclass(frozen=True)
class _Spell:
    table: str
    identity: Cell
    start: Cell
    end: Cell


def _days(a: Column, b: Column) -> Column:
    """Days from a to b, both counted."""
    return (F.lit(1) + F.datediff(b, a)).cast("double")


def _factor() -> Column:
    """Share of a spell's days that lie in the period; NULL for a spell that ends the day before it starts, of no length."""
    return F.try_divide(_days(F.greatest("m_start", "p_start"), F.least("m_end", "p_end")), _days(F.col("m_start"), F.col("m_end")))


def summary_value(m: MeasureRow, value: Column, numeric: bool, only: Column | None = None) -> Column:
    """The aggregate of a measure over the joined rows, or those of them for which `only` holds, as a double."""
    v = value
    if m.summary in control.NUMERIC:
        v = value.cast("double") if numeric else value.cast("string").cast("double")
        v = v * _factor() if m.proportional else v
    if m.summary == "DURATION":
        v = _days(F.greatest("m_start", "p_start"), F.least("m_end", "p_end")) if m.proportional else _days(F.col("m_start"), F.col("m_end"))
    if only is not None:
        v = F.when(only, v)
    agg = {
        "MIN": lambda: F.min(v),
        "MAX": lambda: F.max(v),
        "SUM": lambda: F.sum(v),
        "DURATION": lambda: F.sum(v),
        "MEAN": lambda: F.avg(v),
        "COUNT": lambda: F.count(v),
        "HISTOGRAM": lambda: F.count(v),
        "DISTINCT": lambda: F.count_distinct(v),
        "EXISTS": lambda: (F.count(v) >= 1).cast("int"),
    }[m.summary]()
    return agg.cast("double")


def _people(populations: list[tuple[PopulationRow, DataFrame]]) -> DataFrame:
    """All population rows' members and periods, numbered by row; rows on one table share a scan of it."""
    by_table: dict[str, tuple[DataFrame, list[Column]]] = {}
    for i, (p, df) in enumerate(populations):
        if not p.identity.is_column:
            raise ValueError("the identity of a population must be a column")
        cells = F.struct(
            F.lit(i).alias("p_no"),
            p.identity.column().alias("p_id"),
            p.label_identity.column().cast("string").alias("p_label"),
            p.start.column().cast("date").alias("p_start"),
            p.end.column().cast("date").alias("p_end"),
            p.label_period.column().cast("string").alias("p_period"),
        )
        by_table.setdefault(p.table, (df, []))[1].append(cells)
    each = [df.select(F.explode(F.array(*cells)).alias("p")).select("p.*") for df, cells in by_table.values()]
    return reduce(DataFrame.unionByName, each).where("p_id is not null and p_start is not null and p_end is not null")


def _joined(population: DataFrame, spells: DataFrame, s: _Spell, needed: list[str]) -> DataFrame:
    """Population and spells of an identity that share a day; end days count on both sides."""
    m = spells.select(
        s.identity.column().alias("m_id"),
        s.start.column().cast("date").alias("m_start"),
        s.end.column().cast("date").alias("m_end"),
        *[quoted(c).alias(f"m_{c}") for c in needed],
    )
    meet = (F.col("p_id") == F.col("m_id")) & (F.col("p_start") <= F.col("m_end")) & (F.col("m_start") <= F.col("p_end"))
    return population.join(m, meet)


KEYS = ["p_id", "p_label", "p_start", "p_end", "p_period"]
#: What a part groups by. As one structure it is not what the join was partitioned by, so partial results are formed in the
#: join's tasks and shuffled by group: that leaves Spark free to split the join of an identity with very many spells.
GROUP = ["p_no", *KEYS]


def long_thin(populations: list[tuple[PopulationRow, DataFrame]], measures: list[tuple[MeasureRow, DataFrame]], development: bool = False) -> DataFrame:
    """The assembled long-thin table: one row per identity, period and label with at least one overlapping spell.

    Population members without any such spell are not in it; a value is NULL where all values it summarises are. Repeated
    population rows count their spells once each, as a join does. development keeps some rows of each part only.
    """
    groups: dict[_Spell, list[MeasureRow]] = {}
    tables: dict[str, DataFrame] = {}
    for m, df in measures:
        groups.setdefault(_Spell(m.table, m.identity, m.start, m.end), []).append(m)
        tables[m.table] = df
        if m.proportional and m.summary in IGNORES_PROPORTION:
            warnings.warn(f"proportional is ignored for {m.summary}", stacklevel=2)
    # a development run cuts the rows of each population row and measure, so they stay apart
    people = [_people([p]) for p in populations] if development else [_people(populations)]
    each = [(s, [m]) for s, ms in groups.items() for m in ms] if development else list(groups.items())
    parts = [_part(some, tables[s.table], s, ms) for some in people for s, ms in each]
    return reduce(DataFrame.unionByName, [q.limit(DEVELOPMENT_ROWS) if development else q for q in parts])


def _part(people: DataFrame, table: DataFrame, s: _Spell, ms: list[MeasureRow]) -> DataFrame:
    """All measures of one spell table: one join, one grouping by group, part and label.

    Part 0 has no label and holds the measures with a literal one, each a column of the grouping; part i is the i-th measure
    whose label has to be read. Different values are counted by Spark's own rewriting of distinct aggregates, which
    multiplies the joined rows and not the join.
    """
    needed = sorted({c.text for m in ms for c in (m.label, m.value) if c.is_column})
    joined = _joined(people, table, s, needed)
    types = {f.name: f.dataType for f in table.schema}

    def at(c: Cell) -> Column:
        return quoted(f"m_{c.text}") if c.is_column else F.lit(c.text)

    def text(c: Cell) -> Column:
        return number_text(at(c), types[c.text]) if c.is_column else F.lit(c.text)

    plain = [m for m in ms if not m.label.is_column and m.summary != "HISTOGRAM"]
    labelled = [m for m in ms if m.label.is_column or m.summary == "HISTOGRAM"]
    group = F.struct(*GROUP).alias("p")
    rows = joined.select(group, "p_start", "p_end", "m_start", "m_end", *[quoted(f"m_{c}") for c in needed])
    if labelled:
        labels = [F.concat(text(m.label), F.lit("="), text(m.value)) if m.summary == "HISTOGRAM" else text(m.label) for m in labelled]
        kinds = [F.struct(F.lit(0).alias("part"), F.lit(None).cast("string").alias("label"))] if plain else []
        kinds += [F.struct(F.lit(i).alias("part"), x.alias("label")) for i, x in enumerate(labels, 1)]
        rows = rows.withColumn("k", F.explode(F.array(*kinds))).where("k.part = 0 or k.label is not null")
    else:
        rows = rows.withColumn("k", F.struct(F.lit(0).alias("part"), F.lit(None).cast("string").alias("label")))

    def value(m: MeasureRow, part: int) -> Column:
        return summary_value(m, at(m.value), m.value.is_column, F.col("k.part") == part if labelled else None)

    values = [value(m, 0).alias(f"v{i}") for i, m in enumerate(plain)] + [value(m, i).alias(f"w{i}") for i, m in enumerate(labelled, 1)]
    found = rows.groupBy("p", F.col("k.part").alias("part"), F.col("k.label").alias("label")).agg(*values)
    pair = lambda label, value: F.struct(label.alias("label_measure"), F.col(value).alias("value_measure"))
    out = F.array(*[pair(F.lit(m.label.text), f"v{i}") for i, m in enumerate(plain)]) if plain else None
    for i in range(1, len(labelled) + 1):
        one, here = F.array(pair(F.col("label"), f"w{i}")), F.col("part") == i
        out = one if out is None else F.when(here, one).otherwise(out)
    fields = [F.col(f"p.{k}").alias(f) for k, f in zip(KEYS, FIELDS)]
    return found.select(*fields, F.explode(out).alias("x")).select(*FIELDS, "x.*")


def rectangular(long: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """The long-thin table as one row per identity and period with a column per label; missing measures are 0."""
    return pivot_table(long, "label_measure", "value_measure", "sum", labels=labels)


def assemble(
    spark: SparkSession,
    population_control: str | pd.DataFrame | DataFrame,
    measures_control: str | pd.DataFrame | DataFrame,
    output_database: str = "[]",
    output_schema: str = "[]",
    output_long: str | None = None,
    output_rectangular: str | None = None,
    development_mode: bool = False,
    run_checks_only: bool = False,
    silent: bool = False,
    append: bool = False,
    plans: str | None = None,
) -> tuple[DataFrame, DataFrame | None] | None:
    """Read and check both control tables, assemble, and store the long-thin and, if named, the rectangular table.

    All faults of the control tables and of the tables they name are reported together before anything is written; with
    run_checks_only nothing is. append adds to a long-thin table that is there and must have exactly the seven columns.
    Repeated keys in the long-thin table give a warning, and the rectangular table their sums. Returns both tables.
    """
    inform("assembly", "heading", silent)
    population = control.read_control(spark, population_control)
    measures = control.read_control(spark, measures_control)
    issues = control.issues_of(population, "population", control.POPULATION) + control.issues_of(measures, "measures", control.MEASURES)
    issues += control.keyword_issues(measures)
    if not issues:
        issues = control.table_issues(spark, population, "population", control.POPULATION)
        issues += control.table_issues(spark, measures, "measures", control.MEASURES)
    if issues:
        raise ValueError("faults in the control tables:\n" + "\n".join(issues))
    inform("control tables checked", "details", silent)
    if run_checks_only:
        return None
    ps = [(p, spark.table(p.table)) for p in control.population_rows(population)]
    ms = [(m, spark.table(m.table)) for m in control.measure_rows(measures)]
    long = long_thin(ps, ms, development_mode)
    columns = catalog.long_thin_schema().fieldNames()
    long = long.select(F.col("identity_column").cast("bigint"), *columns[1:])
    where = (output_database, output_schema)
    if output_long is None:
        stored = long
    elif append and catalog.table_or_view_exists(spark, *where, output_long):
        if not catalog.has_required_columns(catalog.access_table(spark, *where, output_long), columns, only=True):
            raise ValueError(f"{output_long} does not have the columns of a long-thin table")
        stored = catalog.append_to_table(long, columns, *where, output_long, plans)
    else:
        stored = catalog.write_table(long, *where, output_long, True, plans)
    inform("long-thin table assembled", "details", silent)
    if output_rectangular is None:
        return stored, None
    if not check_all_unique(stored, [*FIELDS, "label_measure"]):
        warnings.warn("the long-thin table holds repeated labels of an identity and period; the rectangular table adds them up", stacklevel=2)
    wide = catalog.write_table(rectangular(stored), *where, output_rectangular, True, plans)
    inform("rectangular table assembled", "details", silent)
    return stored, wide
