"""Tables that grow by whole segments, all bucketed and sorted by one key, kept as files in a folder.

A segment is written once, by one shuffle of its own rows, and is never changed. Grouping or joining any number of segments
by the key needs no shuffle: equal keys lie in files of equal bucket numbers, and a task reads one bucket of all segments.
A segment counts only once its files are complete, so a job that failed half-way left nothing; writing a number again
replaces it. Several segments may be merged to one: it counts instead of theirs from the moment it is complete. One writer
at a time is assumed.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import delete_path, has_files, list_complete

#: The column with a row's segment, as text: first and last of the numbers that are in it, and how often it was replaced.
SEGMENT = "segment"
Range = tuple[int, int]


class Segments:
    """The segments in a folder. keys (plain names) and the number of buckets are the same for the life of a folder: the first
    segment's number holds, which is the session's number of shuffle partitions unless given. With as many buckets as make
    files of some 100 MB, a task's share of all segments fits its memory when it is aggregated by key."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int | None = None) -> None:
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)
        self._wanted = buckets

    def _there(self) -> dict[Range, tuple[int, int]]:
        """Turn and buckets of the complete segments by their numbers; folders are named s<first>-<last>-<turn>-<buckets>."""
        found = [re.fullmatch(r"s(\d+)-(\d+)-(\d+)-(\d+)", x) for x in list_complete(self.spark, self.folder)]
        out: dict[Range, tuple[int, int]] = {}
        for a, b, turn, buckets in sorted(tuple(map(int, m.groups())) for m in found if m):
            out[a, b] = (turn, buckets)
        return out

    def _path(self, r: Range, turn: int, buckets: int) -> str:
        return f"{self.folder}/s{r[0]:09d}-{r[1]:09d}-{turn}-{buckets}"

    @property
    def buckets(self) -> int:
        for _, buckets in self._there().values():
            return buckets
        return self._wanted or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def ranges(self) -> list[Range]:
        """Numbers of the segments that count, in order: those that lie in a wider one do not."""
        have = self._there()
        return sorted(r for r in have if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in have))

    def write(self, df: DataFrame, no: int | None = None) -> int:
        """Store df as a segment, the next one if no number is given; its number is returned."""
        no = max((b for _, b in self.ranges()), default=-1) + 1 if no is None else no
        self._store(df, (no, no))
        return no

    def replace(self, df: DataFrame, ranges: list[Range]) -> Range:
        """Store df, made from the given neighbouring segments, in their place, and delete them. df should still be grouped by
        the keys as it was read: then it is written without a shuffle."""
        whole = (min(a for a, _ in ranges), max(b for _, b in ranges))
        self._store(df, whole)
        self.drop([r for r in ranges if r != whole])
        return whole

    def _store(self, df: DataFrame, r: Range) -> None:
        name, buckets, old = f"tallyloom_{uuid.uuid4().hex}", self.buckets, self._there().get(r)
        turn = old[0] + 1 if old else 0
        rows = df.drop(SEGMENT).repartition(buckets, *[F.col(k) for k in self.keys]).withColumn(SEGMENT, F.lit(f"{r[0]}-{r[1]}-{turn}"))
        delete_path(self.spark, self._path(r, turn, buckets))  # what a failed job left
        w = rows.write.format("parquet").option("compression", "zstd").option("path", self._path(r, turn, buckets))
        w.bucketBy(buckets, *self.keys).sortBy(*self.keys).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay: the table only served to write them
        if old:
            delete_path(self.spark, self._path(r, *old))

    def read(self, ranges: list[Range] | None = None) -> DataFrame | None:
        """Rows of the given segments, or of all that count, with the column SEGMENT; None if there are no segments or no rows."""
        have, wanted = self._there(), self.ranges() if ranges is None else list(ranges)
        # a segment without rows has no files, so none to tell the columns by
        full = next((p for r in reversed(wanted) if has_files(self.spark, p := self._path(r, *have[r]))), None)
        if full is None:
            return None
        schema = self.spark.read.parquet(full).schema
        tick = lambda c: "`" + c.replace("`", "``") + "`"
        name, keys = f"tallyloom_{uuid.uuid4().hex}", ", ".join(map(tick, self.keys))
        columns = ", ".join(f"{tick(f.name)} {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (recursiveFileLookup 'true') "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'"
        )
        rows = self.spark.table(name)  # resolved here, with the list of its files
        self.spark.sql(f"DROP TABLE {name}")
        return rows.where(F.col(SEGMENT).isin([f"{a}-{b}-{have[a, b][0]}" for a, b in wanted]))

    def drop(self, ranges: list[Range]) -> None:
        have = self._there()
        for r in ranges:
            if r in have:
                delete_path(self.spark, self._path(r, *have[r]))


def tiers(ranges: list[Range], fan: int) -> list[Range] | None:
    """The next `fan` neighbouring segments of one tier to merge, a tier's segments holding fan times as many numbers as the
    one's below; None if no tier has so many."""

    def tier(r: Range) -> int:
        t, width = 0, r[1] - r[0] + 1
        while width >= fan:
            t, width = t + 1, width // fan
        return t

    for i in range(len(ranges) - fan + 1):
        some = ranges[i : i + fan]
        if len({tier(r) for r in some}) == 1:
            return some
    return None
