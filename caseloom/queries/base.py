from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Squashed text and its words in the checking engine.
SQUASH = r"trim(regexp_replace(lower({0}), '[ \t\n\r\f]+', ' ', 'g'), ' ')"
HOST = "nullif(lower(regexp_extract({0}, '^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"
SCHEME = "lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
