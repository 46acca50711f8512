"""Percentiles of very many numbers by deterministic buffer collapsing, mergeable across partitions, runs and days.

A group's values fill buffers of K. FAN full buffers of one level collapse into one of the next: their sorted union, every
FAN-th value of it kept, so that each kept value stands for FAN times as many. Buffers of one level all have the same
weight FAN^level, and every collapse into weight W moves no rank by more than W / 2: a group of n values loses at most
n / (2K) ranks per level. Each sketch carries the sum of these bounds, so the bound of a result is known, not assumed;
fewer than K values are kept as they are and give exact percentiles.

Scale: the values are reduced to buffers inside the tasks that read them, before any shuffle. Sketches meet in rounds of
at most MERGE partitions per group, so the hottest group of the largest table sends a task MERGE sketches at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import ship

K, FAN, MERGE = 2048, 16, 64
#: Rows a task groups by key at a time.
AT_ONCE = 200_000
#: Buffers read before finished sketches are passed on: 32 MB.
READ_AT_ONCE = 2_000
SKETCH = "key string, part bigint, level int, err double, items array<double>"


def collapse(buffers: list[np.ndarray], odd: bool) -> np.ndarray:
    """FAN sorted buffers of equal weight as one: evenly spaced positions of their union, starting a half step in.

    The start alternates between the two middle places from one collapse to the next.
    """
    return np.sort(np.concatenate(buffers), kind="stable")[len(buffers) // 2 - int(odd) :: len(buffers)]


class Sketch:
    """levels[i] holds full buffers of weight FAN^i, loose the values not yet in one; err bounds the rank error so far."""

    __slots__ = ("err", "fan", "k", "levels", "loose", "many", "turns")

    def __init__(self, k: int = K, fan: int = FAN) -> None:
        self.k, self.fan, self.levels, self.loose, self.many, self.err, self.turns = k, fan, [[]], [], 0, 0.0, 0

    def add(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.many += len(values)  # of loose values
        if self.many >= self.k:
            x = np.concatenate(self.loose)
            full = len(x) // self.k * self.k
            self.loose, self.many = ([x[full:]] if full < len(x) else []), len(x) - full
            for i in range(0, full, self.k):
                self.push(np.sort(x[i : i + self.k]), 0)

    def push(self, buffer: np.ndarray, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(buffer)
        if len(self.levels[level]) == self.fan:
            out = collapse(self.levels[level], bool(self.turns % 2))
            self.turns += 1
            self.levels[level] = []
            self.err += self.fan ** (level + 1) / 2
            self.push(out, level + 1)

    def rows(self) -> Iterator[tuple[int, float, np.ndarray]]:
        """(level, err, items), err on the first row only; loose values have level -1."""
        err = self.err
        if self.many:
            yield -1, err, np.concatenate(self.loose)
            err = 0.0
        for level, buffers in enumerate(self.levels):
            for b in buffers:
                yield level, err, b
                err = 0.0

    def load(self, level: int, err: float, items: np.ndarray) -> None:
        self.err += err
        if level < 0:
            self.add(np.asarray(items, dtype=float))
        else:
            self.push(np.asarray(items, dtype=float), level)


def _emit(found: dict[str, Sketch], part: int) -> Iterator[pa.RecordBatch]:
    keys, levels, errs, items = [], [], [], []
    for key, s in found.items():
        for level, err, x in s.rows():
            keys.append(key), levels.append(level), errs.append(err), items.append(x)
        if len(items) >= 500:
            yield _batch(keys, part, levels, errs, items)
            keys, levels, errs, items = [], [], [], []
    if keys:
        yield _batch(keys, part, levels, errs, items)


def _batch(keys: list, part: int, levels: list, errs: list, items: list) -> pa.RecordBatch:
    at = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(items)))
    cols = [pa.array(keys, pa.string()), pa.array([part] * len(keys), pa.int64()), pa.array(levels, pa.int32()), pa.array(errs, pa.float64()), lists]
    return pa.RecordBatch.from_arrays(cols, names=["key", "part", "level", "err", "items"])


def partial_sketches(df: DataFrame, key: str, value: str, k: int = K, fan: int = FAN) -> DataFrame:
    """Sketches (SKETCH) of the values of each key in each of df's partitions; nothing is shuffled.

    Values that are NULL or NaN and rows with a NULL key are no part of any percentile and are left out; repeated values
    count as often as they occur. Infinite values are numbers like others. An empty table gives no sketch.
    """
    ship(df.sparkSession)
    clean = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[str, Sketch] = {}
        for keys, values in _gathered(batches):
            d = keys.dictionary_encode()
            codes, names, x = d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist(), values.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            codes, x = codes[order], x[order]
            for v, i, j in zip(*_runs(codes)):
                found.setdefault(names[v], Sketch(k, fan)).add(x[i:j].copy())
        yield from _emit(found, TaskContext.get().partitionId())

    return clean.where("key is not null and value is not null and not isnan(value)").mapInArrow(task, SKETCH)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Columns of batches put together to some AT_ONCE rows, so that a key with few values is handled once, not per batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(len(x) for x in held) >= AT_ONCE:
            yield pa.concat_arrays([x.column(0) for x in held]), pa.concat_arrays([x.column(1) for x in held])
            held = []
    if held:
        yield pa.concat_arrays([x.column(0) for x in held]), pa.concat_arrays([x.column(1) for x in held])


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.array([], int)
    return codes[at], at, np.append(at[1:], len(codes))


def _loaded(rows: pa.Table) -> Iterator[tuple[int, float, np.ndarray]]:
    """(level, err, items) of a table of sketch rows, in order of level and part."""
    rows = rows.sort_by([("level", "ascending"), ("part", "ascending")]).combine_chunks()
    yield from _rows_of(rows.column("level"), rows.column("err"), rows.column("items").combine_chunks())


def _rows_of(levels: pa.Array, errs: pa.Array, lists: pa.ListArray) -> Iterator[tuple[int, float, np.ndarray]]:
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    for i, (level, err) in enumerate(zip(levels.to_pylist(), errs.to_pylist())):
        yield level, err, flat[at[i] : at[i + 1]]


def merge_sketches(sketches: DataFrame, parts: int, k: int = K, fan: int = FAN, merge: int = MERGE) -> DataFrame:
    """One sketch per key from those of at most `parts` partitions (days, runs), in rounds of `merge` parts each.

    Buffers of equal level collapse as in a single sketch, so the error bound is that of the tree; all inputs must have
    been made with the same k and fan. Part numbers only spread the work. A task reads its keys in order, one after the
    other, and holds the sketches of some READ_AT_ONCE buffers besides the one it is at.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s, done, rows = None, None, {}, 0
        for b in batches:
            keys, buckets = b.column("key").to_pylist(), b.column("bucket").to_pylist()
            for key, row in zip(zip(keys, buckets), _rows_of(b.column("level"), b.column("err"), b.column("items"))):
                if key != now:
                    now, s = key, Sketch(k, fan)
                    if rows >= READ_AT_ONCE:
                        yield from _pairs(done)
                        done, rows = {}, 0
                    done[key] = s
                rows += 1
                level, err, items = row
                s.load(level, err, items.copy())
        yield from _pairs(done)

    def _pairs(done: dict[tuple[str, int], Sketch]) -> Iterator[pa.RecordBatch]:
        rows = [(key, part, *r) for (key, part), s in done.items() for r in s.rows()]
        for i in range(0, len(rows), 500):
            cols = list(zip(*rows[i : i + 500]))
            at = np.concatenate([[0], np.cumsum([len(x) for x in cols[4]])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(cols[4])))
            arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64()), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "part", "level", "err", "items"])

    out = sketches
    while True:
        near = out.withColumn("bucket", F.floor(F.col("part") / F.lit(merge)).cast("bigint")).repartition("key", "bucket")
        out = near.sortWithinPartitions("key", "bucket", "level", "part").mapInArrow(task, SKETCH)
        parts = -(-parts // merge)
        if parts <= 1:
            return out


def percentiles(sketches: DataFrame, wanted: list[float], fan: int = FAN) -> DataFrame:
    """key, pct, value, n, rank_error from one sketch per key: the value at rank ceil(pct / 100 x n), at least 1.

    The true rank of value is off by at most rank_error, which is 0 where the sketch still holds every value.
    """

    def task(rows: pa.Table) -> pa.Table:
        levels, errs, items = zip(*_loaded(rows))
        x = np.concatenate(items)
        w = np.concatenate([np.full(len(i), float(fan) ** max(lv, 0)) for lv, i in zip(levels, items)])
        order = np.argsort(x, kind="stable")
        x, cum, n = x[order], np.cumsum(w[order]), w.sum()
        at = np.searchsorted(cum, np.maximum(1, np.ceil(np.asarray(wanted) / 100 * n - 1e-9)))
        bound = sum(errs)  # weights below and up to any value are off by no more
        m = len(wanted)
        return pa.table(
            {
                "key": pa.array([rows.column("key")[0].as_py()] * m, pa.string()),
                "pct": pa.array(wanted, pa.float64()),
                "value": x[np.minimum(at, len(x) - 1)],
                "n": pa.array([int(n)] * m, pa.int64()),
                "rank_error": pa.array([bound] * m, pa.float64()),
            }
        )

    return sketches.groupBy("key").applyInArrow(task, "key string, pct double, value double, n bigint, rank_error double")


def group_percentiles(df: DataFrame, key: str, value: str, wanted: list[float], k: int = K, fan: int = FAN) -> DataFrame:
    """percentiles() of every key of a table: sketched where it lies, merged, and queried."""
    parts = max(1, df.rdd.getNumPartitions()) if not df.isStreaming else 1
    return percentiles(merge_sketches(partial_sketches(df, key, value, k, fan), parts, k, fan), wanted, fan)
