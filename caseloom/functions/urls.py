"""Addresses and hosts, all as expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes under which names are registered one level lower.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "com.mx")
#: Suffixes reserved for documentation and tests.
RESERVED = ("example", "test", "invalid", "localhost", "local", "internal", "example.com", "example.org", "example.net")
TRAILING = ".,;:!?)\"'»"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def http_host(url: Column) -> Column:
    """Lower-case host of an absolute http(s) address, without user and port; else null."""
    host = F.lower(F.regexp_extract(url, r"^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(host, F.lit(""))


def port(url: Column) -> Column:
    text = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:]+:(\d{1,5})(?:[/?#]|$)", 1)
    default = F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80)
    return F.coalesce(F.nullif(text, F.lit("")).cast("int"), default)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, user or fragment; path and query as they are.

    Null where the address is not an absolute http(s) one.
    """
    rest = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^#]*)", 1)
    p = port(url)
    shown = F.when((scheme(url) == "http") & (p == 80) | (scheme(url) == "https") & (p == 443), F.lit("")).otherwise(
        F.concat(F.lit(":"), p.cast("string"))
    )
    return F.when(http_host(url).isNotNull(), F.concat(scheme(url), F.lit("://"), http_host(url), shown, rest))


def same_origin(a: Column, b: Column) -> Column:
    """Equal scheme, host and port (defaults filled in); null where either is no http(s) address."""
    return F.struct(scheme(a), http_host(a), port(a)) == F.when(
        http_host(a).isNotNull() & http_host(b).isNotNull(), F.struct(scheme(b), http_host(b), port(b))
    )


def text_urls(text: Column) -> Column:
    """http(s) addresses in plain text, trailing punctuation cut off, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.])(https?://[^\s<>\"']+)"), 1)
    return F.transform(found, lambda u: F.rtrim(u, F.lit(TRAILING)))


def address_domain(address: Column) -> Column:
    """Domain of a mail address, with or without display name; null without ``@``."""
    last = F.rtrim(F.substring_index(address, "@", -1), F.lit(".> "))
    return F.when(address.contains("@"), F.lower(last))


def addr_spec(entry: Column) -> Column:
    """The bare mailbox of an address entry, lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(entry, r"([^\s<>,;\"'()]+@[^\s<>,;\"'()]+)", 1)), F.lit(""))


def registrable_domain(host: Column) -> Column:
    """The name one level below its public suffix; hosts without a dot and addresses stay."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    short = F.when(two.isin(*SUFFIXES) & (F.size(labels) > 2), F.array_join(F.slice(labels, -3, 3), ".")).otherwise(two)
    return F.when(host.rlike(r"^\d+(\.\d+){3}$") | (F.size(labels) < 2), host).otherwise(short)


def public_ipv4(ip: Column) -> Column:
    """True for addresses that may appear on the public net or in documentation ranges."""
    o = [F.split(ip, r"\.")[i].cast("int") for i in range(4)]
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.greatest(*o).between(0, 255)
    private = (
        (o[0] == 10) | (o[0] == 127) | (o[0] == 0) | (o[0] >= 224) | (o[0] == 169) & (o[1] == 254)
        | (o[0] == 172) & o[1].between(16, 31) | (o[0] == 192) & (o[1] == 168) | (o[0] == 100) & o[1].between(64, 127)
    )
    return F.coalesce(ok & ~private, F.lit(False))


def target_kind(value: Column) -> Column:
    """What can be looked up: hash, ip, url, email, domain, or null with no such shape."""
    return (
        F.when(value.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), "hash")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(value.rlike("^[hH][tT][tT][pP][sS]?://[^/?#]+"), "url")
        .when(value.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "email")
        .when(value.rlike(r"^(?=.{1,253}$)([A-Za-z0-9_-]{1,63}\.)+[A-Za-z]{2,63}\.?$"), "domain")
    )


def send_refusal(url: Column) -> Column:
    """The first reason why an address must not be sent anywhere, or null; the order of the reasons is fixed."""
    host = http_host(url)
    return (
        F.when(url.isNull() | ~scheme(url).isin("http", "https"), "scheme")
        .when(url.rlike(r"^[A-Za-z]+://[^/?#]*@"), "userinfo")
        .when(host.isNull(), "host")
        .when(F.substring_index(host, ".", -1).isin(*RESERVED) | F.substring_index(host, ".", -2).isin(*RESERVED), "reserved_suffix")
        .when(host.rlike(r"^\d+(\.\d+){3}$") & ~public_ipv4(host), "not_public")
        .when(url.rlike(r"(?i)[?&;](?:token|key|secret|password|auth|session|sig|code)="), "credential")
        .when(url.rlike(r"[^/\s=]+@[^/\s&]+\.[A-Za-z]{2,}|%40"), "personal")
    )
