"""The pN_ queries over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bpe, containers, lookalikes, misread, personal, pieces
from caseloom.llm import near_duplicates as nd
from caseloom.llm import tied_splits as ts
from caseloom.plans.staging import staged


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of text parts whose word runs agree to 0.6 or more."""
    pairs = nd.near_duplicate_pairs(_t(spark, d, "text_parts"), "part_key", "text", 3, 12, 0.6)
    return pairs.select(F.col("a").alias("part_a"), F.col("b").alias("part_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each text part with its class, family and number of links (large-star, small-star)."""
    g = nd.near_duplicate_groups(_t(spark, d, "text_parts"), "part_key", "text", 3, 12, 0.6)
    return g.withColumnRenamed("id", "part_key")


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives; with the classes of p1_groups they say as much as all pairs."""
    return nd.near_duplicate_links(_t(spark, d, "text_parts"), "part_key", "text", 3, 12, 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same over documents, on runs of five words and a similarity of 0.8."""
    return nd.near_duplicate_groups(_t(spark, d, "documents"), "doc_id", "text", 5, 5, 0.8).withColumnRenamed("id", "doc_id")


def _case_values() -> list:
    return [ts.group_value(F.col("duplicate_group"), "dup"), ts.group_value(F.col("family_group"), "fam")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of tied sets that the recorded splits keep apart."""
    cases = _t(spark, d, "rag_source_cases")
    tied = staged(ts.tied_records(cases, "case_no", _case_values()), "tied")
    return ts.conflicting_sets(tied, cases, "case_no", "split").select(
        F.col("key").alias("case_no"), F.col("root").alias("root_no")
    )


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each record's split, 70 / 15 / 15, tied records together."""
    cases = _t(spark, d, "rag_source_cases")
    tied = staged(ts.tied_records(cases, "case_no", _case_values()), "tied")
    return ts.assign_splits(tied, "key", ["train", "validation", "test"], [0.70, 0.15, 0.15]).withColumnRenamed("key", "case_no")


def p2_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the splits keep: one row a record, no tied value in two splits, shares near the ones asked for."""
    cases = _t(spark, d, "rag_source_cases")
    got = p2_splits(spark, d)
    values = F.explode(F.array_compact(F.array(*_case_values())))
    held = cases.select("case_no", values.alias("v")).join(got, "case_no").groupBy("v").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    apart = held.agg(F.count_if(F.col("lo") != F.col("hi")).alias("values_apart"), F.count(F.lit(1)).alias("group_values"))
    n = F.count(F.lit(1))
    near = lambda name, want: (F.abs(F.count_if(F.col("split") == name) / n - want) < 0.05).alias(f"{name}_near")
    rows = got.agg(n.alias("records"), F.countDistinct("case_no").alias("distinct_records"), near("train", 0.70), near("validation", 0.15), near("test", 0.15))
    both = rows.unionByName(apart, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Text parts with characters that were read in a wrong charset."""
    return misread.affected(_t(spark, d, "text_parts"), "part_key", "text").select(F.col("id").alias("part_key"))


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected parts with their text as first written, as far as it can be had."""
    return misread.affected(_t(spark, d, "text_parts"), "part_key", "text").withColumnRenamed("id", "part_key")


def _looks(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, k, c: _t(spark, d, t).select(F.lit(c).alias("place"), F.col(k).alias("row_id"), F.col(c).alias("value"))
    links = one("links", "link_id", "hostname").unionByName(one("links", "link_id", "display_text"))
    return links.unionByName(one("parsed_emails", "email_id", "subject"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that look like a watched term without being it."""
    return lookalikes.lookalikes_of(_looks(spark, d), _t(spark, d, "watch_terms"), "ref_id", "place", "canonical")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every hostname, display text and subject in its one form."""
    return lookalikes.same_form(_looks(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Forms that are spelt in several ways."""
    return lookalikes.look_groups(_looks(spark, d))


def _personal(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of text parts, and each entry of the from and to lists."""
    parts = _t(spark, d, "text_parts").select(F.lit("text").alias("place"), F.col("part_key").alias("row_id"), "text")
    mails = _t(spark, d, "parsed_emails")
    entry = lambda p: mails.select(F.lit(p).alias("place"), F.col("email_id").alias("row_id"), F.explode(f"{p}_addresses").alias("text"))
    return parts.unionByName(entry("from")).unionByName(entry("to"))


def _directory(spark: SparkSession, d: str) -> tuple:
    return personal.learned(_t(spark, d, "staff_directory"), "given_name", "family_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of personal information by place and row."""
    return personal.found_kinds(_personal(spark, d), _directory(spark, d))


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text and address entry with placeholders for its personal information."""
    return personal.masked(_personal(spark, d), _directory(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k; null and empty texts have none."""
    return bpe.encode_texts(_t(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.token_counts(_t(spark, d, "documents"), "doc_id", "text")
    return containers.pack(sizes, "id", "n_tokens", 2_048)


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each document (or part of one above 2,048 tokens) with its container."""
    return _packed(spark, d).select(
        F.col("id").alias("doc_id"), F.col("piece").alias("part_no"), F.col("size").alias("n_tokens"), F.col("container").alias("container_no")
    )


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the least possible number by volume, and the share filled."""
    used = _packed(spark, d).groupBy("container").agg(F.sum("size").alias("n"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("n") / 2_048).alias("lower_bound"),
        F.round(F.sum("n") / (F.count(F.lit(1)) * 2_048), 6).alias("fill"), F.max("n").alias("fullest"),
    )


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of documents above 512 tokens, each repeating 64 tokens of the one before."""
    return pieces.split_texts(_t(spark, d, "documents"), "doc_id", "text", 512, 64).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from caseloom.llm.sql import SQL

    return dict(SQL)
