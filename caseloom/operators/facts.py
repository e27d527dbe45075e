"""Links, observables and evidence drawn from message parts, and checks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import urls as u
from caseloom.operators.keyed import registry

_ANCHOR = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
_FORM = r"(?i)<form\b[^>]*?action\s*=\s*[\"']([^\"']*)[\"']"
_IMAGE = r"(?i)<img\b[^>]*?src\s*=\s*[\"']([^\"']*)[\"']"
_IPV4 = r"(?<![\d.])((?:\d{1,3}\.){3}\d{1,3})(?!\d|\.\d)"
_MAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"


def _each(df: DataFrame, keys: list[str], values: Column, role: str, order: int) -> DataFrame:
    return df.select(*keys, F.posexplode(values).alias("pos", "value")).select(
        *keys, F.lit(order).alias("pass_no"), "pos", F.lit(role).alias("role"), "value"
    )


def part_links(parts: DataFrame, keys: list[str], text: str, mime: str) -> DataFrame:
    """(keys, pass_no, pos, role, value, display): links of plain and HTML parts in reading order.

    Plain parts give the addresses in the text; HTML parts give anchors with their
    display text, form targets, images, and the addresses visible in the rendered text.
    """
    plain, rich = parts.where(F.col(mime) == "text/plain"), parts.where(F.col(mime) == "text/html")
    anchors = rich.select(
        *keys, F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(_ANCHOR), 1).alias("h"), F.regexp_extract_all(text, F.lit(_ANCHOR), 2).alias("t"))).alias("pos", "x")
    ).select(*keys, F.lit(0).alias("pass_no"), "pos", F.lit("href").alias("role"), F.col("x.h").alias("value"), F.trim(F.regexp_replace("x.t", "<[^>]+>", "")).alias("display"))
    visible = F.regexp_replace(F.col(text), "<[^>]+>", " ")
    others = (
        _each(rich, keys, F.regexp_extract_all(text, F.lit(_FORM), 1), "form_action", 1)
        .unionByName(_each(rich, keys, F.regexp_extract_all(text, F.lit(_IMAGE), 1), "remote_resource", 1))
        .unionByName(_each(rich, keys, u.text_urls(visible), "visible_url", 2))
        .unionByName(_each(plain, keys, u.text_urls(F.col(text)), "visible_url", 2))
    )
    return anchors.unionByName(others.withColumn("display", F.lit(None).cast("string")))


def display_mismatch(href: Column, display: Column) -> Column:
    """True only where the display text is itself an http(s) address of another, known host."""
    shown, goes = u.http_host(F.trim(display)), u.http_host(href)
    return F.coalesce(shown.isNotNull() & goes.isNotNull() & (shown != goes), F.lit(False))


def text_observables(parts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, type, value, role) of addresses, mailboxes and public IPv4 addresses in texts."""
    urls = _each(parts, keys, u.text_urls(F.col(text)), "visible_url", 0).withColumn("type", F.lit("url")).withColumn("value", u.normalize_url(F.col("value")))
    mails = _each(parts, keys, F.regexp_extract_all(text, F.lit(_MAIL), 1), "mailbox", 1).withColumn("type", F.lit("email")).withColumn("value", F.lower("value"))
    ips = _each(parts, keys, F.regexp_extract_all(text, F.lit(_IPV4), 1), "transport", 2).withColumn("type", F.lit("ip")).where(u.public_ipv4(F.col("value")))
    return urls.unionByName(mails).unionByName(ips).where("value is not null")


def observable_registry(found: DataFrame, order: list[str]) -> DataFrame:
    """One row per (type, value): first place, roles in order of appearance, occurrences, id."""
    r = registry(found, ["type", "value"], "role", order)
    return r.withColumn("id", F.concat(F.lit("obs_"), F.substring(F.sha2(F.concat_ws("|", "type", "value"), 256), 1, 16)))


def evidence(kinds: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(id, predicate, source_ref, value): union of fact projections, each fact once.

    ``kinds``: predicate -> (rows, source reference, value).
    """
    rows = None
    for predicate, (df, ref, value) in sorted(kinds.items()):
        part = df.select(F.lit(predicate).alias("predicate"), ref.cast("string").alias("source_ref"), value.cast("string").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    key = F.concat_ws("|", "predicate", "source_ref", F.coalesce("value", F.lit("")))
    return rows.distinct().withColumn("id", F.concat(F.lit("ev_"), F.substring(F.sha2(key, 256), 1, 16)))


def priority_targets(rows: DataFrame, group: str, bucket: Column, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group by (bucket, order); rows without a bucket are dropped before counting."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy("bucket", *order)
    kept = rows.withColumn("bucket", bucket).where("bucket is not null")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def issues(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, rule_no, code, severity): one row per violated rule, in the order of the rules.

    A rule that is null for a row is not violated.
    """
    hits = [F.when(bad, F.struct(F.lit(i).alias("rule_no"), F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for i, (code, sev, bad) in enumerate(rules)]
    return df.select(key, F.explode(F.array_compact(F.array(*hits))).alias("x")).select(key, "x.rule_no", "x.code", "x.severity")


def closed_keys(df: DataFrame, key: str, json: str, allowed: list[str], required: list[str]) -> DataFrame:
    """(key, extra, missing) of JSON objects whose key set is not as closed; texts that are no objects have null lists."""
    keys = F.json_object_keys(json)
    extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, allowed))))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), keys))
    bad = keys.isNull() | (F.size(extra) > 0) | (F.size(missing) > 0)
    return df.where(F.col(json).isNotNull()).select(key, F.array_join(extra, ",").alias("extra"), F.array_join(missing, ",").alias("missing"), keys.isNull().alias("broken"), bad.alias("bad")).where("bad").drop("bad")


def table_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, was, is): keys added, missing or changed between two keyed tables; null equals null."""
    l = left.select(key, F.col(value).alias("was"), F.lit(1).alias("__l"))
    r = right.select(key, F.col(value).alias("is"), F.lit(1).alias("__r"))
    change = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "missing").otherwise("changed")
    both = l.join(r, key, "full_outer").where("__l is null or __r is null or not (was <=> is)")
    return both.select(key, change.alias("change"), "was", "is")


def long_form(row: DataFrame) -> DataFrame:
    """(path, value) of a one-row table's scalar columns and nested fields, as text."""
    from pyspark.sql import types as T

    def walk(prefix: str, kind: T.DataType) -> list[str]:
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in walk(f"{prefix}.{f.name}" if prefix else f.name, f.dataType)]
        return [prefix]

    pairs = [F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p in walk("", row.schema)]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.path", "x.value")


def chain_walk(hops: Column, start: Column, most: int = 10) -> Column:
    """The addresses reached from ``start`` by following ordered hops (struct from, to); stops at a cycle or after ``most``."""
    begin = F.array(start)

    def step(acc: Column, hop: Column) -> Column:
        here = F.element_at(acc, -1)
        go = (hop["from"] == here) & ~F.array_contains(acc, hop["to"]) & (F.size(acc) <= most)
        return F.when(go, F.concat(acc, F.array(hop["to"]))).otherwise(acc)

    return F.aggregate(hops, begin, step)
