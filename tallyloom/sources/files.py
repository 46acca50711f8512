"""Files of control tables and results."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_table_file(spark: SparkSession, path: str) -> DataFrame:
    """A csv, xls or xlsx file as a table of strings; the ending's case does not matter, others are an error.

    Doubled quotes inside quoted cells are one quote. Workbooks need pandas' optional readers.
    """
    ending = Path(path).suffix.lower()
    if ending == ".csv":
        return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    if ending in (".xls", ".xlsx"):
        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    raise ValueError(f"{path}: only csv, xls and xlsx files are read")


def write_results_csv(df: DataFrame, path: str) -> None:
    """A summary as csv with a header, NULLs empty. Released summaries are small; larger ones keep a file per partition."""
    df.write.mode("overwrite").option("quote", '"').option("escape", '"').csv(path, header=True)
