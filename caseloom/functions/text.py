"""Text expressions; all run inside the JVM unless their name ends in ``_udf``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as both engines of the checks understand it.
WS = r"[ \t\n\r\f]+"
#: Shapes of secrets that never leave the engine, masked in this order.
SECRETS = (
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1[secret]"),
    (r"(?i)((?:api[_-]?key|token|password|passwd|secret)\s*[=:]\s*)[^\s&;,\"']+", "$1[secret]"),
    (r"(https?://)[^/@\s:]+:[^/@\s]+@", "$1[secret]@"),
)


def squash(c: Column) -> Column:
    """Lower case, white space runs to one blank, no outer blanks; null stays null."""
    return F.trim(F.regexp_replace(F.lower(c), WS, " "))


@F.pandas_udf(T.StringType())
def fingerprint_text_udf(text: pd.Series) -> pd.Series:
    """Compatibility composition, case folding and squashing; null stays null."""
    return text.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()), na_action="ignore")


def content_hash(c: Column) -> Column:
    """sha-256 in hex; the empty text hashes to the empty string, null to null."""
    return F.when(c == "", F.lit("")).otherwise(F.sha2(c, 256))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for blank texts, null for null."""
    squashed = squash(c)
    return F.when(squashed == "", F.lit(0)).otherwise(F.size(F.split(squashed, " "))).cast("long")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def choose_body(plain: Column, html: Column) -> Column:
    """Joined plain parts; where there are none, the tag-stripped HTML parts."""
    full = F.filter(plain, lambda x: F.trim(x) != "")
    rich = F.filter(html, lambda x: F.trim(x) != "")
    return F.when(F.size(full) > 0, F.array_join(full, "\n")).otherwise(F.array_join(F.transform(rich, strip_tags), "\n"))


def shingles(c: Column, size: int = 5) -> Column:
    """Distinct hashed runs of ``size`` successive words; none for shorter texts."""
    words = F.split(squash(c), " ")
    n = F.greatest(F.size(words) - size + 1, F.lit(0))
    # shifted copies side by side: an outer array within a lambda would be evaluated per element
    side = F.arrays_zip(*(F.slice(words, i + 1, n).alias(f"w{i}") for i in range(size)))
    runs = F.transform(side, lambda x: F.xxhash64(F.concat_ws(" ", *(x[f"w{i}"] for i in range(size)))))
    return F.when(c.isNull(), F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two distinct sets; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    any_ = F.size(a) + F.size(b) - both
    return F.when(any_ == 0, F.lit(0.0)).otherwise(both / any_)


def group_id(prefix: str, members: Column) -> Column:
    """Content-derived id of a set: prefix and 16 hex digits of its sorted members' hash."""
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.array_join(F.array_sort(members), ","), 256), 1, 16))


def mask_secrets(c: Column) -> Column:
    for pattern, to in SECRETS:
        c = F.regexp_replace(c, pattern, to)
    return c


def mask_secrets_everywhere(df):
    """Masks every string leaf: columns, nested fields, array elements and map values."""

    def leaf(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return mask_secrets(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: leaf(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: leaf(v, kind.valueType))
        if isinstance(kind, T.StructType):
            made = F.struct(*(leaf(c[f.name], f.dataType).alias(f.name) for f in kind.fields))
            return F.when(c.isNotNull(), made)
        return c

    return df.select(*(leaf(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def defang(c: Column) -> Column:
    """Addresses that no reader's click opens: hxxp, (.) in hosts, (at) for @."""
    c = F.regexp_replace(c, "(?i)http(s?)://", "hxxp$1://")
    c = F.regexp_replace(c, r"(?<=[A-Za-z0-9])\.(?=[A-Za-z0-9-]+[A-Za-z0-9.-]*[/:@]|[a-z]{2,}\b)", "[.]")
    return F.replace(c, F.lit("@"), F.lit("[at]"))


def escaped_excerpt(c: Column, n: int) -> Column:
    """The first ``n`` characters, HTML-escaped."""
    cut = F.substring(c, 1, n)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        cut = F.replace(cut, F.lit(raw), F.lit(safe))
    return cut


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), " +"), 1, n), " ")


def merge_notes(*notes: Column) -> Column:
    """The non-empty notes, joined by "; "."""
    return F.concat_ws("; ", *(F.nullif(n, F.lit("")) for n in notes))


def http_date(c: Column) -> Column:
    """Timestamp of a mail or HTTP date (weekday optional, numeric zone or GMT), else null."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"\s*(?:GMT|UTC|UT)$", " +0000")
    bare = F.regexp_replace(bare, r"\s+", " ")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z"))
    )


def iso_datetime_ok(c: Column) -> Column:
    """True for ISO dates with time (``Z`` allowed), false for others, null for null."""
    shape = c.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?$")
    return F.when(c.isNotNull(), shape & F.try_to_timestamp(F.replace(c, F.lit("T"), F.lit(" "))).isNotNull())


@F.pandas_udf(T.StringType())
def fixed6_udf(x: pd.Series) -> pd.Series:
    """Six decimals rounded half to even on the binary value, as C's printf does."""
    return x.map(lambda v: f"{v:.6f}", na_action="ignore")


def canonical_json(*columns: str) -> Column:
    """JSON of the named columns in the order of their names, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_id(prefix: str, *parts: Column) -> Column:
    """Content-derived id: prefix and the hash of the JSON array of the parts (null parts kept)."""
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256))
