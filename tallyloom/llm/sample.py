"""A reproducible sample that keeps its members as data grows: golden-ratio low-discrepancy selection.

Every member has a persistent sequence number, kept in a register: a folder to which each load of the table appends the ids
it brings, numbered on from the greatest number there is, in order of first arrival and id within the load. A number once
given is never computed again, so no row that comes later, whatever its arrival says, can move a member or lose one. A
number's point is the fractional part of number x golden ratio plus a fixed
shift, in exact integer arithmetic on 2^42 steps; members with a point below the rate are selected. Points of successive
numbers cover the unit interval as evenly as any sequence can, so the sample holds its share not only of the whole but of
every stretch of arrivals; a larger rate only adds members.

Scale: a load is one grouping by id, a join with the ids registered so far, which lie bucketed by id and are not shuffled,
and a range sort of the new ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import quoted
from tallyloom.operators.positions import with_positions
from tallyloom.session import new_scratch
from tallyloom.sources.segments import SEGMENT, Segments

BITS = 42
#: 2^42 divided by the golden ratio, rounded to an odd number: every number below 2^42 has a point of its own.
GOLDEN = 2718142227965
SHIFT = 1234567890123


def point(seq: Column, shift: int = SHIFT) -> Column:
    """(seq * GOLDEN + shift) mod 2^42, for seq from 0 to 2^42, in steps that fit 64 bits."""
    half = 1 << 21
    low, high = seq % half, F.shiftright(seq, 21) % half
    return (low * F.lit(GOLDEN) + (high * F.lit(GOLDEN % half)) % half * F.lit(half) + F.lit(shift)) % F.lit(1 << BITS)


class Register:
    """Sequence numbers of members, in a folder that outlives the run. Loads into one folder are made one after the other; a
    load that failed left nothing, and is made again by loading the table again."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.loads = Segments(spark, folder or new_scratch(spark, "register"), ["id"], buckets)

    def load(self, df: DataFrame, id_col: str, arrived: str) -> int:
        """Number the ids of df that the register lacks; how many they were.

        NULL ids are no members. A member's first arrival is the least one that is known; members without any come last in
        their load. Repeated rows, other columns, the rows' order and partitioning make no difference, and loading a table
        again adds nothing. An empty table adds nothing.
        """
        first = df.where(quoted(id_col).isNotNull()).groupBy(quoted(id_col).alias("id")).agg(F.min(quoted(arrived).cast("timestamp")).alias("first_arrived"))
        known, start = self.loads.read(), 0
        if known is not None:
            start = known.agg(F.max("seq")).first()[0] + 1
            first = first.join(known.select("id"), "id", "left_anti")
        order = [F.col("first_arrived").asc_nulls_last(), F.col("id")]
        new = with_positions(first, order, name="place").select("id", "first_arrived", (F.col("place") + F.lit(start)).alias("seq"))
        n = new.count()
        if n:
            self.loads.write(new)
        return n

    def members(self) -> DataFrame | None:
        """id, first_arrived, seq, load of all members so far; None before the first."""
        found = self.loads.read()
        return None if found is None else found.withColumn("load", F.split_part(SEGMENT, F.lit("-"), F.lit(1)).cast("int")).drop(SEGMENT)


def sequence_numbers(df: DataFrame, id_col: str, arrived: str, register: str | None = None) -> DataFrame:
    """id_col, first_arrived, seq: each member of df's register once, df's new ids having been added to it. Without a folder
    a register is made for this call alone, so that the numbers are those of a first load. See Register.load."""
    r = Register(df.sparkSession, register)
    r.load(df, id_col, arrived)
    found = r.members()
    if found is None:
        kind = df.schema[id_col].dataType.simpleString()
        found = df.sparkSession.createDataFrame([], f"id {kind}, first_arrived timestamp, seq bigint")
    return found.select(F.col("id").alias(id_col), "first_arrived", "seq")


def golden_sample(df: DataFrame, id_col: str, arrived: str, rate: float, shift: int = SHIFT, register: str | None = None) -> DataFrame:
    """id_col, seq of the selected members; rate from 0 to 1. Give a register's folder to keep the members of earlier loads
    whatever arrives; see Register.load for nulls, ties and repeats."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    return sequence_numbers(df, id_col, arrived, register).where(selected(F.col("seq"), rate, shift)).select(id_col, "seq")


def selected(seq: Column, rate: float, shift: int = SHIFT) -> Column:
    """Whether a sequence number's point lies in the interval kept."""
    return point(seq, shift) < F.lit(int(rate * (1 << BITS)))


def rows_of_sample(df: DataFrame, id_col: str, sample: DataFrame, sample_id: str) -> DataFrame:
    """The rows of df, all columns and repeats kept, whose id is in the sample; NULL ids are in none."""
    ids = sample.select(F.col(sample_id).alias("_sampled"))
    return df.join(ids, F.col(id_col) == F.col("_sampled"), "left_semi")
