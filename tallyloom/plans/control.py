"""Control tables of an assembly: parsing, checking, and their cells as columns.

A cell in square brackets names a column, a cell in double quotes is a literal. All faults are gathered and reported at
once. Control tables are written by hand: they have hundreds of rows at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import quoted
from tallyloom.names import catalog_name, has_internal_delimiters, is_delimited, remove_delimiters
from tallyloom.sources.catalog import table_or_view_exists
from tallyloom.sources.files import read_table_file

LOCATION = ("database_name", "schema_name", "table_name")
#: Required columns, and the delimiters each may have (fixed values).
POPULATION = {
    **{c: ("[]",) for c in LOCATION},
    "identity_column": ("[]", '"'),
    "label_identity": ("[]", '"'),
    "summary_period_start_date": ("[]", '"'),
    "summary_period_end_date": ("[]", '"'),
    "label_summary_period": ("[]", '"'),
}
MEASURES = {
    **{c: ("[]",) for c in LOCATION},
    "identity_column": ("[]", '"'),
    "measure_period_start_date": ("[]", '"'),
    "measure_period_end_date": ("[]", '"'),
    "label_measure": ("[]", '"'),
    "value_measure": ("[]", '"'),
}
SUMMARIES = ("SUM", "COUNT", "EXISTS", "MIN", "MAX", "DURATION", "HISTOGRAM", "DISTINCT", "MEAN")
NUMERIC = ("MIN", "MAX", "SUM", "MEAN")
PROPORTIONAL = {"true": True, "t": True, "false": False, "f": False}
MOST_ROWS = 10_000


@dataclass(frozen=True)
class Cell:
    """A column's name, or a literal."""

    text: str
    is_column: bool

    @classmethod
    def parse(cls, text: str) -> Cell:
        return cls(remove_delimiters(text, "[]"), True) if is_delimited(text, "[]") else cls(remove_delimiters(text, '"'), False)

    def column(self) -> Column:
        return quoted(self.text) if self.is_column else F.lit(self.text)


@dataclass(frozen=True)
class PopulationRow:
    table: str
    identity: Cell
    label_identity: Cell
    start: Cell
    end: Cell
    label_period: Cell


@dataclass(frozen=True)
class MeasureRow:
    table: str
    identity: Cell
    start: Cell
    end: Cell
    label: Cell
    value: Cell
    summary: str
    proportional: bool


def read_control(spark: SparkSession, source: str | pd.DataFrame | DataFrame) -> list[dict[str, str | None]]:
    """Rows of a control table from a file, a pandas or a Spark table: names in lower case, cells as text, blank as missing."""
    if isinstance(source, str):
        source = read_table_file(spark, source)
    if isinstance(source, DataFrame):
        rows = [r.asDict() for r in source.limit(MOST_ROWS + 1).collect()]
    else:
        rows = source.to_dict("records")
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a control table has at most {MOST_ROWS} rows")

    def text(v: object) -> str | None:
        if v is None or v != v:
            return None
        return str(v).upper() if isinstance(v, bool) else str(v)

    return [{str(k).lower(): text(v) for k, v in r.items()} for r in rows]


def issues_of(rows: list[dict[str, str | None]], kind: str, required: dict[str, tuple[str, ...]]) -> list[str]:
    """Faults of form: columns that are missing, cells that are missing, not delimited as they should be, or hold a delimiter."""
    found = []
    have = set(rows[0]) if rows else set()
    if not rows:
        found.append(f"{kind}: no rows")
    for c, allowed in required.items():
        if rows and c not in have:
            found.append(f"{kind}: column {c} is missing")
            continue
        for i, r in enumerate(rows, 1):
            v = r.get(c)
            where = f"{kind}, row {i}, {c}"
            if v is None or v == "":
                found.append(f"{where}: missing")
                continue
            own = [d for d in allowed if is_delimited(v, d)]
            if not own:
                found.append(f"{where}: {v} should be delimited by {' or '.join(allowed)}")
            elif has_internal_delimiters(v, own[0]):
                found.append(f"{where}: {v} holds a delimiter inside")
    return found


def keyword_issues(rows: list[dict[str, str | None]]) -> list[str]:
    """Faults of the measures' way of summarising and of proportional."""
    found = []
    for c, allowed in (("measure_summarised_by", {s.lower() for s in SUMMARIES}), ("proportional", set(PROPORTIONAL))):
        for i, r in enumerate(rows, 1):
            if c not in r:
                found.append(f"measures: column {c} is missing")
                break
            if (r[c] or "").strip().lower() not in allowed:
                found.append(f"measures, row {i}, {c}: {r[c]} is not one of {', '.join(sorted(allowed))}")
    return found


def table_issues(spark: SparkSession, rows: list[dict[str, str | None]], kind: str, required: dict[str, tuple[str, ...]]) -> list[str]:
    """Faults against the tables: one that is not there, columns that are not, values to sum that are neither numbers nor logical."""
    found = []
    for i, r in enumerate(rows, 1):
        parts = [r[c] or "" for c in LOCATION]
        if not table_or_view_exists(spark, *parts):
            found.append(f"{kind}, row {i}: no table {catalog_name(*parts)}")
            continue
        schema = spark.table(catalog_name(*parts)).schema
        have = {f.name: f.dataType for f in schema}
        for c in required:
            v = r[c] or ""
            if c not in LOCATION and is_delimited(v, "[]") and remove_delimiters(v, "[]") not in have:
                found.append(f"{kind}, row {i}, {c}: no column {v} in {catalog_name(*parts)}")
        value = r.get("value_measure") or ""
        if (r.get("measure_summarised_by") or "").upper() in NUMERIC and is_delimited(value, "[]"):
            kind_of = have.get(remove_delimiters(value, "[]"))
            if kind_of is not None and not isinstance(kind_of, (T.NumericType, T.BooleanType, T.NullType)):
                found.append(f"{kind}, row {i}, value_measure: {value} is {kind_of.simpleString()}, not a number")
    return found


def _table(r: dict[str, str | None]) -> str:
    return catalog_name(*[r[c] or "" for c in LOCATION])


def population_rows(rows: list[dict[str, str | None]]) -> list[PopulationRow]:
    names = ("identity_column", "label_identity", "summary_period_start_date", "summary_period_end_date", "label_summary_period")
    return [PopulationRow(_table(r), *[Cell.parse(r[c]) for c in names]) for r in rows]


def measure_rows(rows: list[dict[str, str | None]]) -> list[MeasureRow]:
    names = ("identity_column", "measure_period_start_date", "measure_period_end_date", "label_measure", "value_measure")
    return [
        MeasureRow(_table(r), *[Cell.parse(r[c]) for c in names], r["measure_summarised_by"].strip().upper(), PROPORTIONAL[r["proportional"].strip().lower()])
        for r in rows
    ]
