"""Session defaults and shared scratch space."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str | int = "*", app: str = "tallyloom", **conf: str) -> SparkSession:
    """A session with the settings this library is tested with; existing sessions are reused.

    Extra settings are given with dots written as double underscores.
    """
    b = (
        SparkSession.builder.appName(app)
        .master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def connection_guidance() -> str:
    """Text on how to open a session; printed and returned."""
    text = (
        "Local:    SparkSession.builder.master('local[*]').getOrCreate()\n"
        "Cluster:  spark-submit --master <url> your_job.py, with SparkSession.builder.getOrCreate()\n"
        "A classic session is needed, not a Connect one: operators with Python tasks ship this package through its context.\n"
        "Set spark.sql.session.timeZone=UTC and, on a cluster, spark.checkpoint.dir to a folder all executors share."
    )
    print(text)
    return text


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set a temporary folder is made and set on a local master, whose tasks all run on this machine; on a
    cluster that is an error, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It is deleted when the driver ends, or by drop_scratch(); what a
    driver that was killed leaves behind is named for its application."""
    path = f"{shared_dir(spark)}/tallyloom-{spark.sparkContext.applicationId}"
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; no result that is still to be computed may rest on them."""
    fs, p = _file_system(spark, scratch_dir(spark))
    fs.delete(p, True)


def new_scratch(spark: SparkSession, what: str = "table") -> str:
    """A path in the application's scratch folder that nothing uses yet."""
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


def list_complete(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders inside one that were written to the end, sorted; none if it is not there."""
    fs, p = _file_system(spark, folder)
    if not fs.exists(p):
        return []
    done = lambda f: f.isDirectory() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if done(f))


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder has files of data: those whose names begin with a dot or an underscore are not."""
    fs, p = _file_system(spark, path)
    return any(f.isFile() and f.getPath().getName()[0] not in "._" for f in fs.listStatus(p))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def write_shared(df: DataFrame, what: str = "table", codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the scratch folder and read it back: survives lost executors, cuts the lineage."""
    spark = df.sparkSession
    path = new_scratch(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(df: DataFrame) -> None:
    """Delete the files behind a table made by write_shared, once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete_path(df.sparkSession, f)


def partitions_for(df: DataFrame, each: int = 64 << 20) -> int | None:
    """How many partitions a table takes at about `each` bytes of its estimated size, at most 100,000; None where that is not
    known or the session's own number of shuffle partitions is enough, which leaves Spark free to use fewer."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(100_000, -(-size // each)) if size < 1 << 60 else 0
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's executors, once per application; operators with Python tasks call it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tallyloom-")) / "tallyloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
