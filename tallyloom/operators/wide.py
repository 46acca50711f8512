"""Entity, attribute, value rows as one wide typed row per entity, by log-structured upserts.

A batch of rows becomes a sparse wide delta: one row per entity with a map from attribute id to a cell, each cell with its
own version. Compaction takes any number of such runs and keeps, per cell, the value of the latest version, together with
what is needed to know whether the cell ever held a value that does not suit it or that disagrees with another.

Cell states merge associatively, so runs may be compacted in any grouping: all at once, tier by tier, or run by run as
batches arrive. Stored runs are sorted and bucketed by entity (see tallyloom.streaming.wide_ingest) and are compacted
without a shuffle. A table that is turned at once is compacted while it is read: every task reduces its rows to versioned
cells, and one exchange by entity and attribute merges the tasks' cells.

Scale: the attributes are broadcast, their number being checked, so the table itself is never shuffled for them; hot
attributes and hot entities leave a task as one row a cell; a wide row never holds more cells than there are attributes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import folded, quoted

CELL = "struct<ver:timestamp,val:double,lo:double,hi:double,bad:boolean,n:bigint>"
#: The allowed difference of two values of a cell, with room for the rounding of binary fractions.
TOLERANCE, NOISE = 0.01, 1e-9


@dataclass(frozen=True)
class WideSpec:
    """Columns of the long table. keys identify a wide row; carry are further columns constant within a key."""

    keys: tuple[str, ...]
    label: str
    value: str
    version: str
    carry: tuple[str, ...] = ()
    known: tuple[str, ...] = ()  # keys that must not be NULL


def suits(value: Column, kind: Column) -> Column:
    """Whether a value fits 'flag' (0 or 1), 'whole' (a whole number from 0 on) or 'real' (any number)."""
    return (
        F.when(kind == "flag", value.isin(0.0, 1.0))
        .when(kind == "whole", (value >= 0) & (value % F.lit(1.0) == 0))
        .otherwise(F.lit(True))
    )


def label_ids(reference: DataFrame, label: str, kind: str, first: int = 1) -> list[tuple[int, str, str]]:
    """(id, label, kind) of a reference table in order of its labels; the table is a schema, bounded by the number of
    columns a wide table can have (checked)."""
    rows = reference.select(label, kind).where(F.col(label).isNotNull()).distinct().orderBy(label).limit(20001).collect()
    if len(rows) > 20000:
        raise ValueError("more than 20000 attributes: not a schema of a wide table")
    return [(i, r[0], r[1]) for i, r in enumerate(rows, first)]


def _label_table(df: DataFrame, ids: list[tuple[int, str, str]]) -> DataFrame:
    """Ids and kinds by folded label; at most some 20,000 short rows, as label_ids() checks."""
    t = df.sparkSession.createDataFrame(ids, "label_id int, label_name string, label_kind string")
    return t.select("label_id", "label_kind", folded(F.col("label_name")).alias("label_key")).where("label_key is not null")


def _keys(spec: WideSpec) -> list[str]:
    return [f"k_{k}" for k in spec.keys]


def _carry(spec: WideSpec) -> list[str]:
    return [f"v_{c}" for c in spec.carry]


def cell_states(df: DataFrame, spec: WideSpec, ids: list[tuple[int, str, str]], batch: Column | None = None) -> DataFrame:
    """keys, batch if given, label_id, cell, unlisted, carry: the versioned cells of all rows, merged per cell.

    Rows whose label is NULL or not in ids make one row with label_id NULL per key, and unlisted is their number. Labels
    agree when their letters and digits do. NULL and NaN values make no cell state, but the entity still gets its row.
    Of several values of one cell with equal version the largest wins. A NULL version is older than any other. Rows
    with a NULL in spec.known are left out.
    """
    value = quoted(spec.value).cast("double")
    known = [quoted(k).isNotNull() for k in spec.known]
    rows = df.where(reduce(lambda a, b: a & b, known, F.lit(True))).select(
        *[quoted(k).alias(f"k_{k}") for k in spec.keys],
        *[quoted(c).alias(f"v_{c}") for c in spec.carry],
        *([] if batch is None else [batch.alias("batch")]),
        folded(quoted(spec.label)).alias("label_key"),
        F.coalesce(quoted(spec.version).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("ver"),
        F.when(~F.isnan(value), value).alias("val"),
    )
    listed = rows.join(F.broadcast(_label_table(df, ids)), "label_key", "left")
    val, none = F.when(F.col("label_id").isNotNull(), F.col("val")), F.col("label_id").isNull()
    cells = listed.groupBy(*_keys(spec), *([] if batch is None else ["batch"]), "label_id").agg(
        F.max(F.when(val.isNotNull(), F.struct("ver", "val"))).alias("top"),
        F.min(val).alias("lo"),
        F.max(val).alias("hi"),
        F.coalesce(F.bool_or(~suits(val, F.col("label_kind"))), F.lit(False)).alias("bad"),
        F.count(F.coalesce(val, F.when(none, 0.0))).alias("n"),  # values of a cell, rows of the unlisted
        *[F.max(c).alias(c) for c in _carry(spec)],
    )
    return cells.select(
        *_keys(spec),
        *([] if batch is None else ["batch"]),
        "label_id",
        F.struct(F.col("top.ver").alias("ver"), F.col("top.val").alias("val"), "lo", "hi", "bad", F.when(none, 0).otherwise(F.col("n")).alias("n")).alias("cell"),
        F.when(none, F.col("n")).alias("unlisted"),
        *_carry(spec),
    )


def _packed(cells: DataFrame, spec: WideSpec, batch: Column) -> DataFrame:
    """Cells that lie together by key as sparse wide rows."""
    some = F.col("label_id").isNotNull() & (F.col("cell.n") > 0)
    by = [*_keys(spec), *(["batch"] if "batch" in cells.columns else [])]
    out = cells.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.when(some, F.struct("label_id", "cell")))).alias("cells"),
        F.coalesce(F.sum("unlisted"), F.lit(0)).alias("unlisted"),
        *[F.max(c).alias(c) for c in _carry(spec)],
    )
    return out.select(*_keys(spec), (F.col("batch") if "batch" in by else batch).alias("batch"), "cells", "unlisted", *_carry(spec))


def sparse_deltas(df: DataFrame, spec: WideSpec, ids: list[tuple[int, str, str]], batch: Column | None = None, partitions: int | None = None) -> DataFrame:
    """keys, carry, batch, cells, unlisted: a sparse wide row per key and batch.

    cells maps attribute ids to versioned cells; unlisted is the number of rows whose label is NULL or not in ids. batch
    defaults to the version's day. See cell_states for nulls, repeats and labels. The rows lie in partitions by key, as many
    as asked for.
    """
    cells = cell_states(df, spec, ids, batch if batch is not None else quoted(spec.version).cast("date"))
    return _packed(cells.repartition(*([partitions] if partitions else []), *_keys(spec)), spec, F.lit(None).cast("date"))


def _merged(a: Column, b: Column) -> Column:
    """One cell of two, either of which may be missing."""
    first = F.struct(a["ver"], a["val"]) >= F.struct(b["ver"], b["val"])
    both = F.struct(
        F.when(first, a["ver"]).otherwise(b["ver"]).alias("ver"),
        F.when(first, a["val"]).otherwise(b["val"]).alias("val"),
        F.least(a["lo"], b["lo"]).alias("lo"),
        F.greatest(a["hi"], b["hi"]).alias("hi"),
        (a["bad"] | b["bad"]).alias("bad"),
        (a["n"] + b["n"]).alias("n"),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def compact_runs(runs: DataFrame, spec: WideSpec) -> DataFrame:
    """One run, of the same form as its inputs (batch is NULL: none is needed any more), the latest version's value of each
    cell kept. Runs that lie bucketed by key are merged without a shuffle. A task holds a key's rows of all runs at a time;
    those of a key that only one run has are kept as they are."""
    rows = runs.groupBy(*_keys(spec)).agg(
        F.collect_list("cells").alias("maps"), F.coalesce(F.sum("unlisted"), F.lit(0)).alias("unlisted"), *[F.max(c).alias(c) for c in _carry(spec)]
    )
    rest = F.slice("maps", F.lit(2), F.size("maps"))
    cells = F.aggregate(rest, F.element_at("maps", 1), lambda a, b: F.map_zip_with(a, b, lambda _, x, y: _merged(x, y)))
    return rows.select(*_keys(spec), F.lit(None).cast("date").alias("batch"), cells.alias("cells"), "unlisted", *_carry(spec))


def compact_cells(runs: DataFrame, spec: WideSpec) -> DataFrame:
    """keys, label_id, cell, unlisted, carry: compact_runs() with a row per cell.

    Each key also has one row with label_id NULL, which carries unlisted and the carried columns.
    """
    one = F.explode(
        F.concat(
            F.array(F.struct(F.lit(None).cast("int").alias("label_id"), F.lit(None).cast(CELL).alias("cell"))),
            F.transform(F.map_entries("cells"), lambda e: F.struct(e["key"].alias("label_id"), e["value"].alias("cell"))),
        )
    )
    head = F.col("e.label_id").isNull()
    rows = compact_runs(runs, spec).select(*_keys(spec), "unlisted", *_carry(spec), one.alias("e"))
    return rows.select(*_keys(spec), "e.label_id", "e.cell", F.when(head, F.col("unlisted")).alias("unlisted"), *[F.when(head, F.col(c)).alias(c) for c in _carry(spec)])


def unclear(cell: Column) -> Column:
    """Whether a cell has no single fitting value: one that does not suit its kind, or two that differ by more than TOLERANCE."""
    apart = (cell["hi"] != cell["lo"]) & ((cell["hi"] - cell["lo"]) > TOLERANCE + NOISE)
    return F.coalesce(cell["bad"] | apart, F.lit(False))


def wide_of_cells(cells: DataFrame, spec: WideSpec, ids: list[tuple[int, str, str]], together: bool = False) -> DataFrame:
    """One row per key, from merged cells: keys, carry, a typed column per attribute (flag int, whole bigint, real double),
    unclear, unlisted.

    An unclear cell is NULL in its column and its attribute's name is in the sorted array unclear; a cell without value
    is NULL too, and not in it. A whole number beyond bigint is NULL in its column and in the run's cell only. together: a
    key's cells lie in one partition already, as those of stored runs do.
    """
    kinds = {"flag": "int", "whole": "bigint", "real": "double"}
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    names = F.expr(f"map({', '.join(f'{i}, {text(n)}' for i, n, _ in ids)})" if ids else "cast(null as map<int, string>)")
    bad = unclear(F.col("cell"))
    rows = cells.select(*_keys(spec), "label_id", F.when(~bad, F.col("cell.val")).alias("val"), F.when(bad, F.col("label_id")).alias("off"), "unlisted", *_carry(spec))
    ready = (rows if together else rows.repartition(*_keys(spec))).groupBy(*_keys(spec)).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("val").isNotNull(), F.struct("label_id", "val")))).alias("__clear"),
        F.collect_list("off").alias("__off"),
        F.coalesce(F.sum("unlisted"), F.lit(0)).alias("__unlisted"),
        *[F.max(c).alias(c) for c in _carry(spec)],
    )
    ready = ready.withColumn("__unclear", F.array_sort(F.transform("__off", lambda i: F.element_at(names, i))))
    tick = lambda x: "`" + x.replace("`", "``") + "`"
    fixed = [f"{tick(a + x)} AS {tick(x)}" for a, xs in (("k_", spec.keys), ("v_", spec.carry)) for x in xs]
    # as text: hundreds of columns are parsed much faster than built call by call
    cols = [f"try_cast(__clear[{i}] AS {kinds.get(kind, 'double')}) AS {tick(name)}" for i, name, kind in ids]
    return ready.selectExpr(*fixed, *cols, "__unclear AS unclear", "__unlisted AS unlisted")


def wide_rows(run: DataFrame, spec: WideSpec, ids: list[tuple[int, str, str]]) -> DataFrame:
    """wide_of_cells() of a run, or of several runs together."""
    return wide_of_cells(compact_cells(run, spec), spec, ids, True)


def unclear_cells(cells: DataFrame, spec: WideSpec, ids: list[tuple[int, str, str]]) -> DataFrame:
    """keys, attribute: the cells without a single fitting value, from merged cells."""
    names = cells.sparkSession.createDataFrame([(i, n) for i, n, _ in ids], "label_id int, label_name string")
    hit = cells.where(unclear(F.col("cell"))).select(*[F.col(f"k_{k}").alias(k) for k in spec.keys], "label_id")
    return hit.join(F.broadcast(names), "label_id").select(*spec.keys, F.col("label_name").alias(spec.label))
