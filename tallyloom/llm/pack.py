"""Whole documents into containers of a fixed capacity with little room left over.

Dominance reduction first: a set of sizes that provably leaves no better choice for its largest item is fixed for good,
and the instance shrinks; what no rule settles is placed by best fit in decreasing order. An instance is only the number
of items of each size from 1 to the capacity, so both steps cost the same for a thousand documents and for a trillion,
and their result is a short list of runs: so many items of one size into so many successive containers.

Scale: the histogram (at most capacity + 1 rows) is all the driver sees. Documents find their run by their global
position in the order of size and id. With C the capacity there are at most about 3C sqrt(2C) runs, as a container never
holds more than sqrt(2C) different sizes: 1.1 million for 4,096, some 35 MB, the bound of what is sent to the executors.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.llm import vocab
from tallyloom.llm.encode import count_tokens
from tallyloom.operators.positions import with_positions
from tallyloom.session import ship, write_shared


@dataclass
class Plan:
    """runs: (size, first item of the size, items, first container, items per container)."""

    capacity: int
    left: dict[int, int]
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    containers: int = 0
    fixed: int = 0
    taken: dict[int, int] = field(default_factory=dict)

    def take(self, size: int, items: int, container: int, each: int) -> None:
        at = self.taken.get(size, 0)
        self.runs.append((size, at, items, container, each))
        self.taken[size] = at + items
        self.left[size] -= items
        if not self.left[size]:
            del self.left[size]

    def fix(self, sizes: list[int]) -> None:
        """As many containers of exactly these sizes as the items allow."""
        times = min(self.left[s] // sizes.count(s) for s in set(sizes))
        for s in sorted(set(sizes)):
            self.take(s, times * sizes.count(s), self.containers, sizes.count(s))
        self.containers += times
        self.fixed += times


def dominating(left: dict[int, int], order: list[int], j: int, capacity: int) -> list[int] | None:
    """Sizes, j among them, of a set that dominates every feasible set with j; None if no rule proves one.

    order: the sizes there are, ascending. A set dominates another if the other's items, in groups, fit in place of its
    own. Rules: nothing fits beside j; the largest partner fills the container; only one partner ever fits; at most two
    fit and the largest partner is worth the best two, or the best two bound every single and pair.
    """
    room = capacity - j
    have = lambda s: left[s] - (s == j)
    at = bisect_left(order, room + 1) - 1
    while at >= 0 and not have(order[at]):
        at -= 1
    if at < 0:
        return [j]
    k = order[at]
    if k == room:
        return [j, k]
    small: list[int] = []
    for s in order:
        small += [s] * min(3 - len(small), have(s))
        if len(small) == 3:
            break
    if len(small) < 2 or small[0] + small[1] > room:
        return [j, k]
    if len(small) == 3 and sum(small) <= room:
        return None
    best, a, b = 0, 0, 0
    lo, hi = 0, at
    while lo <= hi:
        x, y = order[lo], order[hi]
        ok = have(x) and have(y) and (lo != hi or have(x) >= 2)
        if x + y > room:
            hi -= 1
        else:
            if ok and x + y > best:
                best, a, b = x + y, y, x
            lo += 1
    if best <= k:
        return [j, k]
    if a == k:
        more = [s for s in order[bisect_left(order, b + 1) : at + 1] if have(s)]
        if not more or more[0] + (more[0] if have(more[0]) >= 2 else (more + [room])[1]) > room:
            return [j, a, b]
    return None


def reduce_by_dominance(plan: Plan) -> None:
    """Fix sets while some size has a dominating one; sizes are tried from the largest down, again until nothing changes."""
    changed = True
    while changed:
        changed = False
        for j in sorted(plan.left, reverse=True):
            while plan.left.get(j):
                found = dominating(plan.left, sorted(plan.left), j, plan.capacity)
                if found is None:
                    break
                plan.fix(found)
                changed = True


def best_fit(plan: Plan) -> None:
    """All items left, in decreasing size, each into the fullest container opened here that has room for it."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, n))

    for s in sorted(plan.left, reverse=True):
        while plan.left.get(s):
            n = plan.left[s]
            at = bisect_left(rooms, s)
            if at < len(rooms):
                g = rooms[at]
                first, m = open_[g].pop()
                if not open_[g]:
                    del open_[g], rooms[at]
            else:
                g = plan.capacity
                first, m = plan.containers, -(-n // (g // s))
                plan.containers += m
            each = g // s
            full = min(m, n // each)
            rest = n - full * each if full < m else 0
            if full:
                plan.take(s, full * each, first, each)
                put(g - each * s, first, full)
            if rest:
                plan.take(s, rest, first + full, rest)
                put(g - rest * s, first + full, 1)
            used = full + bool(rest)
            put(g, first + used, m - used)


def plan_containers(sizes: dict[int, int], capacity: int) -> Plan:
    """The plan for so many items of each size; sizes are from 1 to capacity."""
    plan = Plan(capacity, {s: n for s, n in sizes.items() if n})
    reduce_by_dominance(plan)
    best_fit(plan)
    return plan


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """id_col, size_col, piece, piece_size, container: one row per piece of every item.

    An item up to capacity is one piece. A larger one is cut into pieces of capacity, each a container of its own, and
    the remainder, packed like any item. Items of size 0, NULL or less take no room: one piece of size 0 in container 0.
    Repeated rows and equal or NULL ids are items of their own; other columns are dropped. No items give no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    spark = items.sparkSession
    ship(spark)
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    sizes = write_shared(items.select(F.col(id_col).alias("id"), size.alias("size")), "sizes")  # counted once, read twice
    pieces = (
        sizes.select("id", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)))).alias("piece"))
        .withColumn("piece_size", F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint"))
    )
    placed = with_positions(pieces, ["piece_size", "id", "piece"])
    counts = {r[0]: r[1] for r in placed.groupBy("piece_size").agg(F.count(F.lit(1))).collect()}  # at most capacity + 1 rows
    start, n = {}, 0
    for s in sorted(counts):
        start[s], n = n, n + counts[s]
    empty = counts.pop(0, 0)
    plan = plan_containers(counts, capacity)
    rows = ([(0, 0, empty, 0, empty)] if empty else []) + plan.runs
    runs = np.array(sorted((start[s] + at, box, each) for s, at, _, box, each in rows), np.int64).reshape(-1, 3)
    shared = spark.sparkContext.broadcast(runs)
    schema = placed.select("id", "size", "piece", "piece_size").schema.add("container", T.LongType())
    arrow = to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, box, each = shared.value.T
        for b in batches:
            at = b.column("position").to_numpy()
            i = np.searchsorted(first, at, side="right") - 1
            cols = [b.column(c).cast(arrow.field(c).type) for c in ("id", "size", "piece", "piece_size")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(box[i] + (at - first[i]) // each[i])], names=schema.names)

    out = placed.select("id", "size", "piece", "piece_size", "position").mapInArrow(task, schema)
    return out.select(F.col("id").alias(id_col), F.col("size").alias(size_col), "piece", "piece_size", "container")


def pack_documents(
    df: DataFrame, id_col: str, text_col: str, capacity: int = 4096, name: str = vocab.DEFAULT, path: str | None = None
) -> DataFrame:
    """pack() of documents by the number of tokens of their texts: id_col, n_tokens, piece, piece_size, container.

    NULL and empty texts have no tokens and go to container 0.
    """
    return pack(count_tokens(df, id_col, text_col, name, path), id_col, "n_tokens", capacity)
