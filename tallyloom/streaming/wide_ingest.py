"""Attribute rows, a stream's or in loads, into the stored runs of a log-structured wide table.

Every batch is stored as one run of sparse wide deltas, sorted and bucketed by entity. Compaction merges neighbouring runs
tier by tier, bucket by bucket, without a shuffle; a cell's versions settle the order, however late a row comes. All runs
together, compacted or not, give the same wide rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyloom.operators import wide
from tallyloom.sources.segments import SEGMENT, Segments, tiers

#: Runs of a tier that are merged to one of the next.
FAN = 4


def runs_in(spark: SparkSession, folder: str, spec: wide.WideSpec, buckets: int | None = None) -> Segments:
    """The runs of a folder, bucketed by the wide table's keys."""
    return Segments(spark, folder, [f"k_{k}" for k in spec.keys], buckets)


def append_batch(rows: DataFrame, batch_id: int, folder: str, spec: wide.WideSpec, ids: list[tuple[int, str, str]], buckets: int | None = None) -> None:
    """Store a batch as one run. Writing a batch again replaces it, so a restarted stream repeats nothing; a batch that has
    been merged already is not written again."""
    runs = runs_in(rows.sparkSession, folder, spec, buckets)
    if any(a <= batch_id <= b and a < b for a, b in runs.ranges()):
        return
    runs.write(wide.sparse_deltas(rows, spec, ids, batch=F.lit(None).cast("date"), partitions=runs.buckets), batch_id)


def ingest(stream: DataFrame, folder: str, checkpoint: str, spec: wide.WideSpec, ids: list[tuple[int, str, str]], buckets: int | None = None) -> DataStreamWriter:
    """A writer that appends every micro-batch of a stream of attribute rows; start() it. No state is kept between batches."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: append_batch(df, i, folder, spec, ids, buckets))


def read_runs(spark: SparkSession, folder: str, spec: wide.WideSpec) -> DataFrame | None:
    """All runs of a folder, None if there are none or they have no rows; grouping them by key needs no shuffle."""
    found = runs_in(spark, folder, spec).read()
    return None if found is None else found.drop(SEGMENT)


def compact(spark: SparkSession, folder: str, spec: wide.WideSpec, fan: int = FAN, everything: bool = False) -> list[tuple[int, int]]:
    """Merge the folder's runs tier by tier while a tier has `fan` of them, or all to one; the runs that are left, by numbers
    of their batches. A cell is written again once per tier, so about log_fan of the number of batches times. Runs that are
    all without rows are dropped."""
    runs = runs_in(spark, folder, spec)
    while (some := runs.ranges() if everything else tiers(runs.ranges(), fan)) and len(some) > 1:
        if (found := runs.read(some)) is None:
            runs.drop(some)
        else:
            runs.replace(wide.compact_runs(found.drop(SEGMENT), spec), some)
    return runs.ranges()
