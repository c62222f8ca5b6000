"""Sinks: JSON lines, CSV, replacing one group of an evidence table. None overwrites unless that is its purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(df: DataFrame, path: str) -> None:
    """Keys in order; NaN or an infinity fails the write, which leaves no _SUCCESS mark; an existing path is refused."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    checked = [F.when(bad(c), F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(F.col(c)).alias(c) if c in floats else F.col(c) for c in sorted(df.columns)]
    df.select(checked).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in this order with a header; null is an empty field."""
    df.select(columns).write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def replace_group(rows: DataFrame, path: str, group: str) -> None:
    """Write rows, partitioned by group; only the groups they hold are replaced, all others stay byte for byte."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)
