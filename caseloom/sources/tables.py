"""Strict tables: JSON lines with closed schemas, manifests with exact columns, audits, index folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of a JSON-lines file.

    Blank lines are skipped.  A line that is no object, has unknown or missing keys, or
    repeats the key is a problem with its text, never a silently null row.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    names = [f.name for f in schema.fields]
    keys = F.json_object_keys("value")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    problem = (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, names)))) > 0, "unknown keys")
        .when(F.size(F.array_except(F.array(*map(F.lit, names)), keys)) > 0, "missing keys")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated keys")
    )
    read = lines.select("value", row.alias("row"), problem.alias("problem"))
    good = read.where("problem is null").select("row.*")
    bad = read.where("problem is not null").select("value", "problem")
    if key:
        repeats = good.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        bad = bad.unionByName(repeats.select(F.col(key).cast("string").alias("value"), F.lit("repeated key").alias("problem")))
    return good, bad


def exact_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table whose columns must be exactly the schema's, in order."""
    df = spark.read.parquet(path)
    want = [f.name for f in schema.fields]
    if df.columns != want:
        raise ValueError(f"columns are {df.columns}, not {want}")
    return df


def last_attempts(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """Of archived attempts (``<run>/attempt_<n>.json``) the last of each run."""
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    at = F.input_file_name()
    tagged = rows.withColumn("run", F.regexp_extract(at, r"([^/]+)/attempt_\d+\.json$", 1)).withColumn(
        "attempt", F.regexp_extract(at, r"attempt_(\d+)\.json$", 1).cast("int")
    )
    names = [f.name for f in schema.fields]
    last = tagged.groupBy("run").agg(F.max("attempt").alias("attempt"), F.max_by(F.struct(*names), "attempt").alias("r"))
    return last.select("run", "attempt", *(F.col(f"r.{n}").alias(n) for n in names))


def open_index(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """An index table, only if it was written under the same fingerprint."""
    meta = spark.read.text(f"{path}/fingerprint").first()
    if meta is None or meta[0].strip() != fingerprint:
        raise ValueError("the index was written with another fingerprint")
    return spark.read.parquet(f"{path}/rows")
