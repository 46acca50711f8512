"""Tables and views: access, create, append, write, view, drop, and saved query plans."""

from __future__ import annotations

import datetime as dt
import re
import time
import uuid
import warnings
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyloom.names import catalog_name

#: Column types as control tables write them, and as Spark writes them (fixed values).
TYPES = {"int": "int", "bigint": "bigint", "date": "date", "float(53)": "double", "float": "double", "datetime": "timestamp"}


def spark_type(declared: str) -> tuple[str, bool]:
    """Spark type and whether NULL is allowed, of a declaration such as '[varchar](25) NOT NULL'."""
    text = re.sub(r"[\[\]]", "", declared).strip().lower()
    nullable = not re.search(r"\bnot\s+null\b", text)
    base = re.sub(r"\s*\b(not\s+)?null\b", "", text).replace(" ", "")
    if base in TYPES:
        return TYPES[base], nullable
    if re.fullmatch(r"(var)?char\(\d+\)", base):
        return base, nullable
    raise ValueError(f"unknown column type {declared!r}")


def table_or_view_exists(spark: SparkSession, db: str = "[]", schema: str = "[]", table: str = "") -> bool:
    return spark.catalog.tableExists(catalog_name(db, schema, table))


def access_table(spark: SparkSession, db: str = "[]", schema: str = "[]", table: str = "") -> DataFrame:
    """A lazy DataFrame on a table or view; an error if there is none."""
    if not table_or_view_exists(spark, db, schema, table):
        raise ValueError(f"no table or view {catalog_name(db, schema, table)}")
    return spark.table(catalog_name(db, schema, table))


def has_required_columns(df: DataFrame, columns: list[str], only: bool = False) -> bool:
    """Whether all columns are there, by exact name; with only, whether there are no others either."""
    have, want = set(df.columns), set(columns)
    return want == have if only else want <= have


def save_plan(df: DataFrame | str, description: str, folder: str | None = None) -> str | None:
    """Write a query's plans, or the text of a statement, to '<time> <description>.sql' in a folder, made if need be; nothing without a folder.

    Errors of writing become warnings. Returns the path.
    """
    if folder is None:
        return None
    now = dt.datetime.now()
    name = f"{now:%Y-%m-%d %H%M%S}-{now.microsecond // 1000:03d} {re.sub(r'[. :]', '_', description)}.sql"
    path = Path(folder) / name
    try:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(df if isinstance(df, str) else df._jdf.queryExecution().toString())
        time.sleep(0.002)  # names differ by milliseconds
    except OSError as e:
        warnings.warn(f"could not save {path}: {e}", stacklevel=2)
    return str(path)


def create_table(spark: SparkSession, columns: dict[str, str], db: str = "[]", schema: str = "[]", table: str = "", overwrite: bool = False, plans: str | None = None) -> DataFrame:
    """An empty table with the declared columns; an error if it exists and is not to be overwritten."""
    name = catalog_name(db, schema, table)
    if overwrite:
        delete_table(spark, db, schema, table)
    fields = []
    for c, declared in columns.items():
        kind, nullable = spark_type(declared)
        fields.append("`" + c.replace("`", "``") + f"` {kind}" + ("" if nullable else " NOT NULL"))
    statement = f"CREATE TABLE {name} ({', '.join(fields)}) USING parquet"
    save_plan(statement, f"create {table}", plans)
    spark.sql(statement)
    return spark.table(name)


def append_to_table(df: DataFrame, columns: list[str], db: str = "[]", schema: str = "[]", table: str = "", plans: str | None = None) -> DataFrame:
    """Append the listed columns, matched by name, to an existing table; its other columns become NULL."""
    spark, name = df.sparkSession, catalog_name(db, schema, table)
    target = access_table(spark, db, schema, table)
    for side, have in (("source", df), ("target", target)):
        if missing := [c for c in columns if c not in have.columns]:
            raise ValueError(f"columns missing in the {side}: {missing}")
    chosen = df.select(*["`" + c.replace("`", "``") + "`" for c in columns])
    save_plan(chosen, f"append {table}", plans)
    view = f"tallyloom_{uuid.uuid4().hex}"
    chosen.createTempView(view)
    listed = ", ".join("`" + c.replace("`", "``") + "`" for c in columns)
    try:
        spark.sql(f"INSERT INTO {name} ({listed}) SELECT {listed} FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
    return spark.table(name)


def write_table(
    df: DataFrame,
    db: str = "[]",
    schema: str = "[]",
    table: str = "",
    overwrite: bool = False,
    plans: str | None = None,
    bucket_by: list[str] | None = None,
    buckets: int = 64,
    codec: str = "zstd",
    partition_by: list[str] | None = None,
    sort_by: list[str] | None = None,
) -> DataFrame:
    """Store df as a table and return a DataFrame on what was stored.

    bucket_by clusters and sorts the files by columns, which later joins and groupings on them use without a shuffle: the
    place of an index; sort_by sorts them otherwise. partition_by makes a folder per value. codec is the files' compression.
    """
    spark, name = df.sparkSession, catalog_name(db, schema, table)
    check_case_clashes(df.columns)
    if not overwrite and table_or_view_exists(spark, db, schema, table):
        raise ValueError(f"{name} exists")
    save_plan(df, f"write {table}", plans)
    w = df.write.format("parquet").mode("overwrite" if overwrite else "errorifexists").option("compression", codec)
    if bucket_by:
        w = w.bucketBy(buckets, *bucket_by)
        w = w if sort_by == [] else w.sortBy(*(sort_by or bucket_by))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)
    return spark.table(name)


def write_for_reuse(df: DataFrame, db: str = "[]", schema: str = "[]", table: str = "", index_columns: list[str] | None = None, plans: str | None = None) -> DataFrame:
    """write_table, always overwriting, clustered by the index columns if any."""
    return write_table(df, db, schema, table, True, plans, index_columns)


def rewrite_clustered(spark: SparkSession, columns: list[str], db: str = "[]", schema: str = "[]", table: str = "", buckets: int = 64) -> DataFrame:
    """Store an existing table again, clustered and sorted by columns: what an index is to a row store."""
    return _rewrite(spark, db, schema, table, bucket_by=columns, buckets=buckets)


def compress_table(spark: SparkSession, db: str = "[]", schema: str = "[]", table: str = "", codec: str = "zstd") -> DataFrame:
    """Store an existing table again with another compression; its clustering and partitioning stay."""
    return _rewrite(spark, db, schema, table, codec=codec)


def layout(spark: SparkSession, db: str = "[]", schema: str = "[]", table: str = "") -> dict:
    """How a table is stored: bucket_by, buckets, sort_by, partition_by and codec, as far as they are set."""
    state = spark._jsparkSession.sessionState()
    meta = state.catalog().getTableMetadata(state.sqlParser().parseTableIdentifier(catalog_name(db, schema, table)))
    names = lambda seq: [seq.apply(i) for i in range(seq.size())]
    out: dict = {}
    if meta.bucketSpec().isDefined():
        b = meta.bucketSpec().get()
        out |= {"bucket_by": names(b.bucketColumnNames()), "buckets": b.numBuckets(), "sort_by": names(b.sortColumnNames())}
    if meta.partitionColumnNames().size():
        out["partition_by"] = names(meta.partitionColumnNames())
    codec = meta.storage().properties().get("compression")
    return out | ({"codec": codec.get()} if codec.isDefined() else {})


def _rewrite(spark: SparkSession, db: str, schema: str, table: str, **how) -> DataFrame:
    name, beside = catalog_name(db, schema, table), f"{table.strip('[]')}__rewritten"
    kept = layout(spark, db, schema, table)
    if "bucket_by" in how:
        kept.pop("sort_by", None)
    write_table(access_table(spark, db, schema, table), db, schema, beside, True, **(kept | how))
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {catalog_name(db, schema, beside)} RENAME TO {name}")
    if kept.get("partition_by"):  # a renamed table has to be told of its folders again
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def copy_local(spark: SparkSession, local: pd.DataFrame, db: str = "[]", schema: str = "[]", table: str = "", overwrite: bool = False, plans: str | None = None) -> DataFrame:
    """Store a local pandas table."""
    if not isinstance(local, pd.DataFrame):
        raise TypeError("a pandas DataFrame is needed; a Spark one is stored with write_table")
    return write_table(spark.createDataFrame(local), db, schema, table, overwrite, plans)


def create_view(
    query: DataFrame | str, view: str, overwrite: bool = False, db: str = "[]", schema: str = "[]", plans: str | None = None, spark: SparkSession | None = None
) -> DataFrame:
    """A view on a query; an error if it exists and is not to be overwritten.

    A DataFrame's view lasts for the session and belongs to no database, as Spark keeps no text of it. The text of a SQL
    query becomes a view of the catalog that outlives the session, in a database or schema if one is named.
    """
    save_plan(query, f"view {view}", plans)
    if isinstance(query, str):
        spark, name = spark or SparkSession.active(), catalog_name(db, schema, view)
        spark.sql(f"CREATE {'OR REPLACE ' if overwrite else ''}VIEW {name} AS {query}")
        return spark.table(name)
    if catalog_name(db, schema, view) != catalog_name(table=view):
        raise ValueError("a DataFrame's view belongs to no database; give the text of its query for one that does")
    name = catalog_name(table=view).strip("`")
    query.createOrReplaceTempView(name) if overwrite else query.createTempView(name)
    return query.sparkSession.table(name)


def delete_table(spark: SparkSession, db: str = "[]", schema: str = "[]", table: str = "", mode: str = "table", plans: str | None = None) -> None:
    """Drop a table or a view, if there is one; of views of one name the session's goes first."""
    mode = mode.lower()
    if mode not in ("table", "view"):
        raise ValueError("mode is table or view")
    name = catalog_name(db, schema, table)
    statement = f"DROP {mode.upper()} IF EXISTS {name}"
    save_plan(statement, f"delete {table}", plans)
    if mode == "view" and name.count("`.`") == 0 and spark.catalog.dropTempView(name.strip("`")):
        return
    spark.sql(statement)


def check_case_clashes(columns: list[str]) -> None:
    """Columns that differ by case only cannot be stored; they raise before any work is done."""
    seen: dict[str, str] = {}
    for c in columns:
        if seen.setdefault(c.lower(), c) != c or columns.count(c) > 1:
            raise ValueError(f"columns {seen[c.lower()]!r} and {c!r} differ by case at most")


def long_thin_schema() -> T.StructType:
    """Columns of an assembled long-thin table."""
    return T.StructType(
        [
            T.StructField("identity_column", T.LongType()),
            T.StructField("label_identity", T.StringType()),
            T.StructField("summary_period_start_date", T.DateType()),
            T.StructField("summary_period_end_date", T.DateType()),
            T.StructField("label_summary_period", T.StringType()),
            T.StructField("label_measure", T.StringType()),
            T.StructField("value_measure", T.DoubleType()),
        ]
    )
