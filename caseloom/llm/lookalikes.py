"""One form for texts that look the same: the confusables skeleton.

skeleton = decompose, drop what does not show, replace every character by the prototype
of its shape, decompose again.  Equal skeletons mean equal looks.  Letter case, accents,
digits and plain Latin letters are looks of their own and are kept; width, joining,
composition, kinds of blank, invisible characters and the script of a letter are not.
Hostnames are first decoded to what they show (``xn--`` labels).

Defined results: null stays null, the empty text empty; an encoded label that does not
decode counts as the letters it has; repeated rows give one row; extra columns are
ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values, after the public list of confusable characters (Unicode Technical Standard 39, confusables.txt):
#: letters of other scripts (and phonetic letters) by the Latin letter whose shape they have.
PROTOTYPES = {
    "a": "аɑα", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іıι", "j": "јϳ", "l": "ӏ",
    "n": "ոռ", "o": "оοօσ", "p": "рρ", "q": "ԛգ", "s": "ѕꜱ", "u": "սυ", "v": "νѵᴠ", "w": "ԝաᴡ", "x": "х", "y": "уү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    "-": "‐‑‒–−", ".": "․", "/": "⁄∕", "'": "’‘ʼ",
}
#: Fixed values from the same list: Cherokee, Lisu, Coptic and more phonetic letters.
RARER = {
    "b": "ƅᏏ", "c": "ⲥꮯ", "d": "Ꮷ", "e": "ꬲ℮", "f": "ք", "h": "Ꮒ", "i": "ɩɪᎥꭵ", "j": "յ", "l": "ǀ", "o": "ⲟᴏᴑꬽ", "p": "ⲣϱ", "r": "ⲅꮁꭇꭈᴦ", "s": "ꮪ", "u": "ᴜꭎꭒꞟʋ", "v": "ꮩ", "w": "ꮃѡ", "y": "ʏγꭚᶌ", "z": "ꮓ",
    "A": "Ꭺꓮ", "B": "ⲂꓐᏴ", "C": "ⲤꓚᏟ", "D": "Ꭰꓓ", "E": "Ꭼꓰ", "F": "ꓝϜ", "G": "ᏀᏳꓖ", "H": "ⲎᎻꓧ", "I": "Ⲓꓲ", "J": "Ꭻꓙ", "K": "ⲔᏦꓗ", "L": "Ꮮꓡ", "M": "ⲘᎷꓟϺ", "N": "Ⲛꓠ", "O": "Ⲟꓳ",
    "P": "ⲢᏢꓑ", "R": "ᎡᏒꓣ", "S": "ᏕᏚꓢ", "T": "ⲦᎢꓔ", "U": "ꓴ", "V": "Ꮩꓦ", "W": "ᎳᏔꓪ", "X": "Ⲭꓫ", "Y": "ⲨᎩꓬ", "Z": "Ꮓꓜ",
}
#: Invisible characters that are not of category Cf.
_UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_SHAPE = {ord(x): proto for table in (PROTOTYPES, RARER) for proto, alike in table.items() for x in alike}
#: Compatibility decompositions that keep the look: width, font, no-break forms.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>")


#: Signs that part the labels of a hostname as the full stop does.
_DOTS = re.compile("[。．｡]")


class _Table(dict):
    """Code point -> what it is replaced by after decomposition; filled on demand."""

    def __missing__(self, cp: int) -> str | None:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if ch.isspace() or kind == "Zs" or cp == 0x2800:
            to: str | None = " "
        elif kind in ("Cf", "Cc") or cp in _UNSEEN:
            to = None
        elif cp in _SHAPE:
            to = _SHAPE[cp]
        else:
            to = ch
            tag, _, rest = unicodedata.decomposition(ch).partition(" ")
            # joined letters (fi, ffi) and Roman numerals are compatibility forms that look like their letters
            joined = tag == "<compat>" and (0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F or 0x1C7 <= cp <= 0x1CC)
            if tag in _SAME_LOOK or joined:
                to = "".join(unicodedata.normalize("NFD", chr(int(x, 16))) for x in rest.split()).translate(self)
        self[cp] = to
        return to


_TABLE = _Table()


def skeleton(text: str | None) -> str | None:
    if text is None or text.isascii() and text.isprintable():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_TABLE))


def shown_hostname(host: str | None) -> str | None:
    """A hostname as it is shown: encoded labels decoded."""
    if host is None:
        return host
    host = _DOTS.sub(".", host)
    if "xn--" not in host.lower():
        return host
    labels = []
    for label in host.split("."):
        if label[:4].lower() == "xn--":
            try:
                label = label[4:].encode("ascii").decode("punycode")
            except (UnicodeError, ValueError, IndexError, OverflowError):
                pass
        labels.append(label)
    return ".".join(labels)


@F.pandas_udf(T.StringType())
def skeleton_udf(text: pd.Series) -> pd.Series:
    return text.map(skeleton, na_action="ignore")


@F.pandas_udf(T.StringType())
def hostname_skeleton_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: skeleton(shown_hostname(x)), na_action="ignore")


@F.pandas_udf(T.StringType())
def one_form_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", skeleton(x)), na_action="ignore")


def readable(text: str) -> str:
    """The text in composed, plain-width form without what does not show; letters stay in a word of one script."""

    def word(m: re.Match) -> str:
        kinds = {unicodedata.name(c, "?").split(" ")[0] for c in m[0] if c.isalpha()}
        if len(kinds) == 1 and kinds & {"CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU"}:
            return m[0]
        return skeleton(m[0])

    shown = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) not in ("Cf", "Cc") and ord(c) not in _UNSEEN)
    return unicodedata.normalize("NFC", re.sub(r"\S+", word, re.sub(r"\s", " ", shown)))


@F.pandas_udf(T.StringType())
def readable_udf(text: pd.Series) -> pd.Series:
    return text.map(readable, na_action="ignore")


def skeletons(place: Column, value: Column) -> Column:
    """Skeleton of a value by its place: hostnames are decoded first."""
    return F.when(place == "hostname", hostname_skeleton_udf(F.when(place == "hostname", value))).otherwise(
        skeleton_udf(F.when(place != "hostname", value))
    )


def same_form(values: DataFrame) -> DataFrame:
    """(place, row_id, value, form, readable) of every row with a value; equal looks, equal form.

    ``form`` is the key of comparison; ``readable`` leaves words of one script in it.
    """
    shape = values.select("place", "row_id", "value").where("value is not null").distinct()
    return shape.withColumn("skeleton", skeletons(F.col("place"), F.col("value"))).withColumn(
        "form", one_form_udf("skeleton")
    ).withColumn("readable", readable_udf("value")).drop("skeleton")


def look_groups(values: DataFrame) -> DataFrame:
    """(place, form, spellings, rows_n, least, greatest) of forms spelt in several ways.

    Rows are first counted per spelling, so a value that holds a third of all rows
    arrives as one row.
    """
    counted = values.where("value is not null").groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))
    forms = counted.withColumn("form", one_form_udf(skeletons(F.col("place"), F.col("value"))))
    return (
        forms.groupBy("place", "form")
        .agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows_n"), F.min("value").alias("least"), F.max("value").alias("greatest"))
        .where("spellings > 1")
    )


def lookalikes_of(values: DataFrame, terms: DataFrame, term_id: str, term_place: str, term_value: str) -> DataFrame:
    """(place, row_id, ref_id): values that look like a term of their place but differ.

    The planner broadcasts the terms only if they are small enough by its own limit.
    """
    ref = terms.select(F.col(term_place).alias("place"), F.col(term_id).alias("ref_id"), F.col(term_value).alias("canonical"))
    ref = ref.where("canonical is not null").distinct().withColumn("skeleton", skeletons(F.col("place"), F.col("canonical")))
    rows = values.select("place", "row_id", "value").where("value is not null")
    rows = rows.withColumn("skeleton", skeletons(F.col("place"), F.col("value")))
    found = rows.join(ref, ["place", "skeleton"]).where("value <> canonical")
    return found.select("place", "row_id", "ref_id").distinct()
