"""Sinks: staged replacement, no-overwrite, sorted JSON lines, matrices, index folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import mask_secrets_everywhere


def _fs(df: DataFrame, path: str):
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm


def replace_parquet(df: DataFrame, path: str) -> None:
    """Writes beside the target, then swaps: readers see the old table or the new one."""
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(fresh)
    target, fs, jvm = _fs(df, path)
    had = fs.exists(target)
    if had:
        fs.rename(target, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target)
    if had:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def write_once(df: DataFrame, path: str) -> None:
    """JSON rows with secrets masked; an existing target is an error."""
    mask_secrets_everywhere(df).write.mode("errorifexists").json(path)


def sorted_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with sorted keys and nulls, globally ordered over the part files."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.orderBy(*order).select(line.alias("value")).write.mode("errorifexists").text(path)


def matrix_csv(matrix: DataFrame, path: str) -> None:
    """A confusion matrix (one row per label) as one CSV file with a header."""
    matrix.orderBy("truth").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_index(df: DataFrame, path: str, fingerprint: str) -> None:
    """An index table with the fingerprint that readers must present."""
    replace_parquet(df, f"{path}/rows")
    df.sparkSession.createDataFrame([(fingerprint,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/fingerprint")


def drop_index(df: DataFrame, path: str) -> None:
    target, fs, _ = _fs(df, path)
    fs.delete(target, True)
