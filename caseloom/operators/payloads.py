"""Archived lookup responses (JSON) to evidence rows: one projection per kind of source.

Closed vocabularies and status rules are tables below; responses that do not parse give
one row with the status ``unavailable`` and no evidence.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Engine verdict categories that are reported one by one.
ENGINE_COUNTS = ("malicious", "suspicious", "harmless", "undetected", "timeout")
#: What "not found" means differs by kind of source.
NOT_FOUND = {"reputation": "not_found", "sandbox": "pending", "graph": "api_error", "registration": "not_found"}
#: The record types that are reported.
DNS_TYPES = ("A", "AAAA", "MX", "NS", "TXT")


def http_status(kind: Column, code: Column) -> Column:
    """Tool status of an HTTP code, by kind of source."""
    missing = F.lit("not_found")
    for k, v in NOT_FOUND.items():
        missing = F.when(kind == k, F.lit(v)).otherwise(missing)
    return (
        F.when(code.between(200, 299), "ok").when(code == 404, missing).when(code.isin(401, 403), "auth")
        .when(code == 429, "rate_limited").when(code.between(500, 599), "server_error").when(code.isNull(), "unavailable").otherwise("api_error")
    )


def _facts(rows: DataFrame, keys: list[str], pairs: list[tuple[str, Column]]) -> DataFrame:
    held = F.array(*(F.struct(F.lit(p).alias("predicate"), v.cast("string").alias("value")) for p, v in pairs))
    return rows.select(*keys, F.explode(F.filter(held, lambda x: x["value"].isNotNull())).alias("x")).select(*keys, "x.predicate", "x.value")


def engine_verdicts(rows: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Counts per category, the total over all categories (unknown ones too), the address and the scan time."""
    stats = F.from_json(F.get_json_object(body, "$.data.attributes.last_analysis_stats"), "map<string,bigint>")
    at = lambda p: F.get_json_object(body, p)
    pairs = [(f"engine_{c}", stats[c]) for c in ENGINE_COUNTS]
    pairs += [
        ("engine_total", F.when(stats.isNotNull(), F.aggregate(F.map_values(stats), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("bigint"))))),
        ("scanned_url", at("$.data.attributes.url")), ("last_scan", at("$.data.attributes.last_analysis_date")),
    ]
    return _facts(rows, keys, pairs)


def graph_matches(rows: DataFrame, keys: list[str], value: str, body: str) -> DataFrame:
    """The first node whose value or one of whose hashes equals the asked value, with labels and score."""
    shape = "array<struct<node:struct<id:string,observable_value:string,hashes:map<string,string>,x_score:bigint,labels:array<string>>>>"
    edges = F.from_json(F.get_json_object(body, "$.data.observables.edges"), shape)
    hit = F.filter(edges, lambda e: (F.lower(e["node"]["observable_value"]) == F.lower(value)) | F.exists(F.coalesce(F.map_values(e["node"]["hashes"]), F.array().cast("array<string>")), lambda h: F.lower(h) == F.lower(value)))
    node = F.get(hit, 0)["node"]
    return rows.select(*keys, node.alias("n")).where("n is not null").select(
        *keys, F.col("n.id").alias("node_id"), F.col("n.x_score").alias("score"), F.array_join(F.array_sort(F.slice("n.labels", 1, 10)), ",").alias("labels")
    )


def page_facts(rows: DataFrame, keys: list[str], body: str) -> DataFrame:
    """Final address, title, verdict and screenshot of a page scan; the redirect chain is walked separately."""
    at = lambda p: F.get_json_object(body, p)
    return _facts(rows, keys, [
        ("final_url", at("$.page.url")), ("page_title", F.substring(at("$.page.title"), 1, 200)), ("page_status", at("$.page.status")),
        ("sandbox_malicious", at("$.verdicts.overall.malicious")), ("sandbox_score", at("$.verdicts.overall.score")), ("screenshot", at("$.task.screenshotURL")),
    ])


def redirect_hops(rows: DataFrame, keys: list[str], body: str) -> DataFrame:
    """(keys, hops): ordered (from, to) pairs of the requests that were redirected, where both ends are known."""
    shape = "array<struct<request:struct<request:struct<url:string>,redirectResponse:struct<url:string>>>>"
    reqs = F.from_json(F.get_json_object(body, "$.data.requests"), shape)
    hops = F.transform(reqs, lambda r: F.struct(r["request"]["redirectResponse"]["url"].alias("from"), r["request"]["request"]["url"].alias("to")))
    return rows.select(*keys, F.filter(hops, lambda h: h["from"].isNotNull() & h["to"].isNotNull()).alias("hops"))


def registration_facts(rows: DataFrame, keys: list[str], body: str) -> DataFrame:
    """First date per action, the registrar's name, up to 10 statuses and 10 name servers."""
    events = F.from_json(F.get_json_object(body, "$.events"), "array<struct<eventAction:string,eventDate:string>>")
    when = lambda a: F.get(F.filter(events, lambda e: F.lower(e["eventAction"]) == a), 0)["eventDate"]
    entities = F.from_json(F.get_json_object(body, "$.entities"), "array<struct<roles:array<string>,vcardArray:string>>")
    registrar = F.get(F.filter(entities, lambda e: F.array_contains(e["roles"], "registrar")), 0)["vcardArray"]
    servers = F.from_json(F.get_json_object(body, "$.nameservers"), "array<struct<ldhName:string>>")
    status = F.from_json(F.get_json_object(body, "$.status"), "array<string>")
    return _facts(rows, keys, [
        ("registered", when("registration")), ("changed", when("last changed")), ("expires", when("expiration")),
        ("registrar", F.nullif(F.regexp_extract(registrar, r'\[\s*"fn"\s*,\s*\{[^}]*\}\s*,\s*"text"\s*,\s*"([^"]*)"', 1), F.lit(""))),
        ("statuses", F.nullif(F.array_join(F.slice(status, 1, 10), ","), F.lit(""))),
        ("name_servers", F.nullif(F.array_join(F.slice(F.transform(servers, lambda x: F.lower(x["ldhName"])), 1, 10), ","), F.lit(""))),
    ])


def dns_facts(answers: DataFrame, keys: list[str], rtype: str, pos: str, value: str) -> DataFrame:
    """Up to 10 answers of each type in order; texts over 512 characters are only counted."""
    from pyspark.sql import Window

    long = (F.col(rtype) == "TXT") & (F.length(value) > 512)
    known = answers.where(F.col(rtype).isin(*DNS_TYPES)).withColumn("omitted", long)
    w = Window.partitionBy(*keys, rtype).orderBy(pos)
    kept = known.where(~F.col("omitted")).withColumn("n", F.row_number().over(w)).where("n <= 10")
    rows = kept.select(*keys, F.concat(F.lit("dns_"), F.lower(rtype)).alias("predicate"), F.col(value).alias("value"))
    counts = known.where("omitted").groupBy(*keys).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return rows.unionByName(counts.select(*keys, F.lit("dns_txt_omitted").alias("predicate"), "value"))


def certificate_facts(certs: DataFrame, keys: list[str], not_before: str, name: str) -> DataFrame:
    """Number of certificates, first and last start, up to 20 distinct names in order.

    Names are made distinct and cut to 20 per target before they are collected.
    """
    from pyspark.sql import Window

    base = certs.groupBy(*keys).agg(F.count(F.lit(1)).alias("certificates"), F.min(not_before).alias("first"), F.max(not_before).alias("last"))
    names = certs.where(F.col(name).isNotNull()).select(*keys, F.lower(name).alias("name")).distinct()
    top = names.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("name"))).where("r <= 20")
    listed = top.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return base.join(listed, keys, "left")


def fenced_json(c: Column) -> Column:
    """The JSON inside the only code fence of a text; null for none or several, or if it does not parse."""
    fences = F.regexp_extract_all(c, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), 1)
    inner = F.when(F.size(fences) == 1, F.rtrim(fences[0], F.lit(" \r\n\t")))
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def usage(body: Column) -> Column:
    """Token counts of an archived model response; null where the response has none."""
    at = lambda p: F.get_json_object(body, p).cast("bigint")
    return F.struct(
        at("$.usage.prompt_tokens").alias("input"), at("$.usage.prompt_tokens_details.cached_tokens").alias("cached"),
        at("$.usage.completion_tokens").alias("output"), at("$.usage.completion_tokens_details.reasoning_tokens").alias("reasoning"),
    )


#: Elements whose content is not shown as text, and those whose content is no markup.
_UNSHOWN = ("script", "style", "noscript", "template", "svg")
_RAW = ("script", "style", "title", "textarea")
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def inert_html(markup: str) -> tuple[str, str, list[str]]:
    """(title, shown text, form fields as type:name) of HTML that is read and never run.

    One pass over the tags: the content of raw elements is skipped to its end tag, text
    within unshown elements is dropped, everything else is text.
    """
    title, shown, fields = [], [], []
    at, inside = 0, []  # inside: unshown elements that are open
    while m := _MARKUP.search(markup, at):
        if not inside:
            shown.append(markup[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            if name in inside:
                del inside[len(inside) - 1 - inside[::-1].index(name) :]
            continue
        if name in ("input", "select", "textarea"):
            said = {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(m["rest"]))}
            fields.append(f"{html.unescape(said.get('type') or name)}:{html.unescape(said.get('name') or '')}")
        if name in _RAW:
            close = re.compile(rf"</{name}\b[^>]*>|\Z", re.I).search(markup, at)
            if not inside:
                (title if name == "title" else shown if name == "textarea" else []).append(markup[at : close.start()])
            at = close.end()
        elif name in _UNSHOWN and not m["rest"].rstrip().endswith("/"):
            inside.append(name)
    if not inside:
        shown.append(markup[at:])
    plain = lambda xs, sep: " ".join(html.unescape(sep.join(xs)).split())
    return plain(title, ""), plain(shown, " "), fields


def dom_facts(df: DataFrame, key: str, content: str, limit: int = 4_000, fields: int = 50) -> DataFrame:
    """(key, title, visible_text, form_fields) of HTML as inert data; null reads as empty; bounded lengths are part of the record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [inert_html(x or "") for x in b.column(1).to_pylist()]
            cols = pa.array([t[:200] for t, _, _ in got], pa.string()), pa.array([x[:limit] for _, x, _ in got], pa.string()), pa.array([f[:fields] for _, _, f in got], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, "title", "visible_text", "form_fields"])

    return df.select(key, content).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, title string, visible_text string, form_fields array<string>")
