"""Small column builders; all stay inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: All ASCII characters other than letters and digits.
_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def quoted(name: str) -> Column:
    """Column by its exact name, dots and odd characters included."""
    return F.col("`" + name.replace("`", "``") + "`")


def folded(c: Column) -> Column:
    """Letters a-z and digits of a label in order, lower case; NULL if none is left.

    Two labels are the same exactly when their folded forms agree.
    """
    plain = F.translate(c.cast("string"), _MARKS, "")  # a pattern takes twice the time, so only what is beyond ASCII gets one
    ascii_only = F.octet_length(plain) == F.char_length(plain)
    key = F.when(ascii_only, plain).otherwise(F.regexp_replace(plain, "[^A-Za-z0-9]", ""))
    return F.nullif(F.lower(key), F.lit(""))


def number_text(c: Column, kind: T.DataType) -> Column:
    """A value as text, whole floating numbers without a decimal point (1.0 gives '1')."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
        return F.when(whole, d.cast("decimal(20,0)").cast("string")).otherwise(d.cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("TRUE")).when(~c, F.lit("FALSE"))
    return c.cast("string")


def label_uniform(cols: list[Column]) -> Column:
    """Uniform number in [0, 1) that depends only on the set of a row's label values.

    NULLs are dropped and the values sorted, so neither the columns' order nor swapped values change it.
    """
    text = F.array_join(F.array_sort(F.array_compact(F.array(*[c.cast("string") for c in cols]))), " ")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def not_in(c: Column, values: list) -> Column:
    """Whether a value is none of a list's; NULL is none of them unless the list holds it. Never NULL itself."""
    known = [v for v in values if v is not None]
    there = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    return ~(there | c.isNull()) if None in values else ~there
