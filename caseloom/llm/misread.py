"""Text that was decoded with a wrong charset: found and restored by best-first search.

A state is a text; an operation encodes it with one charset and decodes it with another
(all of it, or only the runs that form multi-byte characters), or unescapes character
references.  States wait in a heap by what they cost: the implausibility of their
characters (``plausibility.Model``, fitted on sentences of some fifty languages) and the
price of the way to them.  States met before, known by their hash, are not entered again.
A recoding whose least possible cost is known from its single characters waits under that
bound and is carried out only when its turn comes, so nothing cheaper is passed over.

Once the cheapest state reached is plausible, only states that look cheaper or were
reached at a lower price are still expanded.  The search ends when ways of at most
``DEPTH`` operations are exhausted, or after ``EXPANSIONS`` states were expanded; the last
is reported in the column ``cut``.

A change is made only if the text reached is plausible in itself (no token's
doubt above ``PLAUSIBLE``) and cheaper by ``MARGIN`` than the text as it stands, the
price of the way included; of two readings about as good the text stays as it is.  All
recodings are one to one (strict UTF-8, single-byte tables completed by C1 controls), so
the way run backwards gives the input; the one exception is the no-break space of a
two-byte character that has become a blank since.

The search looks at the distinct doubtful tokens of a text; no step back may make them
less plausible by more than ``WORSE``.  The way found is then carried out on the whole
text and judged by it.

A text is searched as a whole; what stays implausible is searched by line, by sentence
and by word, so passages and single words are found too.

Defined results: null, empty and plain ASCII texts without references are not affected
(text that became ASCII, as in UTF-7 or transfer encodings, is left alone); a text with a
replacement character is affected although that character stays lost; repeated rows give
one row in ``affected``; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.bpe import slices
from caseloom.llm.plausibility import KINDS, LOST, model, script

#: Doubt of the least plausible token: up to SOUND no search, above PLAUSIBLE no result.
SOUND, PLAUSIBLE = 2.0, 4.5
#: Nats that a repair must save beyond its price.
MARGIN = 2.2
DEPTH, EXPANSIONS = 3, 24
#: Nats by which a step on the way may be worse than the text searched.
WORSE = 4.0
#: Tokens of more doubt than this are what a search looks at; its way is then tried on all of the text.
DOUBT = 1.8
#: Charsets that texts are read in by mistake, with the price (in nats) of that mistake.
READ_AS = {
    "cp1252": 0.0, "latin-1": 0.3, "mac-roman": 1.0, "cp850": 1.2, "cp437": 1.2, "cp1251": 1.0, "cp1250": 1.5, "iso8859-15": 1.5, "iso8859-2": 1.8, "koi8-r": 1.8, "cp866": 1.8,
    "cp1254": 2.0, "iso8859-9": 2.2, "cp1253": 2.0, "iso8859-7": 2.2, "cp852": 2.2, "cp1257": 2.2, "mac-cyrillic": 2.2, "iso8859-5": 2.2, "gbk": 2.0, "shift_jis": 2.5, "big5": 2.5, "euc-kr": 2.5,
}
#: Charsets that texts were written in, with the price of having been.
WRITTEN_IN = {
    "utf-8": 1.0, "cp1252": 2.0, "cp1251": 3.0, "koi8-r": 3.5, "cp1250": 3.5, "iso8859-2": 3.6, "cp1254": 4.0, "cp1253": 4.0, "mac-roman": 4.5, "cp850": 4.5, "cp866": 4.5, "shift_jis": 4.5, "gbk": 4.5,
    "euc-kr": 4.5, "big5": 5.0, "euc_jp": 5.0, "cp852": 4.8, "cp1257": 4.8, "cp1255": 4.8, "cp1256": 4.8, "iso8859-5": 5.0, "mac-cyrillic": 5.0, "koi8-u": 4.0, "cp437": 5.0,
}
_MULTI = ("utf-8", "shift_jis", "gbk", "big5", "euc-kr", "euc_jp")
CHEAPEST = 1.0
#: The price of a way that another passage of the same text has taken already, as a share.
AGAIN = 0.3


def _c1(error: UnicodeError):
    """Bytes without a character in a charset stand for the control characters of the same number, and back."""
    if isinstance(error, UnicodeEncodeError):
        bad = error.object[error.start : error.end]
        if all(0x80 <= ord(c) <= 0x9F for c in bad):
            return bytes(ord(c) for c in bad), error.end
    elif isinstance(error, UnicodeDecodeError) and error.encoding.replace("-", "") != "utf8":
        return "".join(map(chr, error.object[error.start : error.end])), error.end
    raise error


codecs.register_error("caseloom-c1", _c1)

_REFERENCE = re.compile(r"&(?:[A-Z][A-Za-z]{2,7}|[a-z]{3,8}|#\d{2,5}|#x[0-9a-fA-F]{2,4});")


def _unescape(text: str) -> str:
    return _REFERENCE.sub(lambda m: x if not (x := html.unescape(m[0])).isascii() else m[0], text)


def judge(text: str) -> tuple[float, float]:
    """(cost, doubt of the worst token); references count as what they stand for."""
    return model().judge(_unescape(text) if "&" in text else text)


def cost(text: str) -> float:
    return judge(text)[0]


# ---- operations ---------------------------------------------------------------
def _mode(charset: str) -> str:
    return "strict" if charset in _MULTI else "caseloom-c1"


@lru_cache(maxsize=None)
def _shown(charset: str) -> tuple[str, ...]:
    """The characters of the bytes 128 to 255 of a single-byte charset."""
    return tuple(bytes([b]).decode(charset, "caseloom-c1") for b in range(128, 256))


@lru_cache(maxsize=None)
def _high(charset: str) -> frozenset[str]:
    return frozenset(_shown(charset))


@lru_cache(maxsize=None)
def _multibyte(charset: str) -> tuple[re.Pattern, re.Pattern]:
    """Runs of characters of ``charset`` whose bytes may be multi-byte UTF-8 characters; first characters before a blank."""
    some = lambda lo, hi: "[" + "".join(re.escape(c) for c in _shown(charset)[lo - 128 : hi - 128]) + "]"
    more = some(0x80, 0xC0)
    runs = re.compile(f"(?:{some(0xC2, 0xE0)}{more}|{some(0xE0, 0xF0)}{more}{{2}}|{some(0xF0, 0xF5)}{more}{{3}})+")
    return runs, re.compile(f"(?<![A-ZÀ-Þ])({some(0xC3, 0xC4)}|(?<=[{re.escape(_shown(charset)[0x50])}{re.escape(_shown(charset)[0x51])}]){some(0xD0, 0xD1)}) ")


@lru_cache(maxsize=None)
def _table(read_as: str, written_in: str) -> tuple[dict[int, str], dict[str, float]]:
    """Of two single-byte charsets: what each character becomes, and the least that can cost."""
    to = dict(zip(_shown(read_as), _shown(written_in), strict=True))
    return {ord(c): x for c, x in to.items()}, {c: _least(x) for c, x in to.items()}


@lru_cache(maxsize=None)
def _least(ch: str) -> float:
    """The least a character can cost wherever it stands."""
    kind, flat = KINDS[ch]
    if kind != "l":
        return flat
    m = model()
    low = ch.lower() if len(ch.lower()) == 1 else ch
    best = [-math.log(max(single[low], 0.5) / total) * 0.5 if low in letters else 9.0 for letters, single, _, _, total, *_ in m.stats]
    return min(*best, m._unknown("^", low))


def _recode(text: str, read_as: str, written_in: str) -> str | None:
    try:
        got = text.encode(read_as, _mode(read_as)).decode(written_in, _mode(written_in))
        # tables of eastern Asia are not one to one: the way back must give the text
        return got if read_as not in _MULTI or got.encode(written_in).decode(read_as) == text else None
    except (UnicodeError, ValueError):
        return None


def _runs(text: str, read_as: str, controls: bool = False) -> str:
    """Runs of whole characters recoded; with ``controls`` also those that become control characters (for now)."""

    def one(m: re.Match) -> str:
        got = _recode(m[0], read_as, "utf-8")
        return got if got is not None and (controls or not any(KINDS[c][0] == "x" or c == LOST for c in got)) else m[0]

    return _multibyte(read_as)[0].sub(one, text)


def _blanked(text: str, read_as: str) -> str:
    """First bytes before a plain blank that was the second byte (A0, a no-break space) once."""
    return _multibyte(read_as)[1].sub(lambda m: _recode(m[1] + "\xa0", read_as, "utf-8") + (" " if text[m.end() : m.end() + 1].isalnum() else ""), text)


_SINGLE = tuple(a for a in READ_AS if a not in _MULTI)
_BLANKS = ("cp1252", "latin-1", "iso8859-15", "cp1250", "cp1254")


def _steps(text: str) -> Iterator[tuple[str, str | None, float, tuple | None]]:
    """Operations on a state: (name, text or None if it waits for its turn, price, charsets).

    For one that waits, the price holds the least cost of its text as well.
    """
    counts = Counter(c for c in text if c > "\x7f")
    lost = counts.pop(LOST, 0)
    if "&" in text and (got := _unescape(text)) != text:
        yield "unescape", got, 0.0, None
        return  # references hide characters from the other operations
    high = set(counts)
    for a in _SINGLE:
        shared = high & _high(a)
        if not shared:
            continue
        price = READ_AS[a] + WRITTEN_IN["utf-8"]
        if (got := _runs(text, a)) != text:
            yield f"{a}>utf-8 runs", got, price, None
        if a in _BLANKS and (raw := _runs(text, a, True)) != got:
            yield f"{a}>utf-8 runs with controls", raw, price, None
        if a in _BLANKS and (bare := _blanked(got, a)) != got:
            yield f"{a}>utf-8 runs and blanks", bare, price + 1.0, None
        if lost or len(shared) < len(high):
            continue
        for b, extra in WRITTEN_IN.items():
            if a == b:
                continue
            if b in _MULTI:
                if b != "utf-8" and (got := _recode(text, a, b)) is not None and got != text:
                    yield f"{a}>{b}", got, READ_AS[a] + extra, None
                continue
            least = _table(a, b)[1]
            yield f"{a}>{b}", None, READ_AS[a] + extra + sum(n * least[c] for c, n in counts.items()), (a, b, READ_AS[a] + extra)
    if not lost and any(script(c) == "CJK" for c in high):
        for a in _MULTI[1:]:
            for b in ("utf-8", "gbk", "shift_jis", "big5", "euc-kr"):
                if a in READ_AS and a != b and (got := _recode(text, a, b)) is not None and got != text:
                    yield f"{a}>{b}", got, READ_AS[a] + WRITTEN_IN[b], None


class Way:
    """The outcome of a search: operations, their price, and whether it was cut short."""

    __slots__ = ("ops", "paid", "cut")

    def __init__(self, ops: tuple[str, ...] = (), paid: float = 0.0, cut: bool = False):
        self.ops, self.paid, self.cut = ops, paid, cut


def _again(op: str, text: str) -> str | None:
    """The operation of that name, carried out on a text."""
    if op == "unescape":
        return _unescape(text)
    a, _, b = op.partition(">")
    if b.startswith("utf-8 runs"):
        got = _runs(text, a, b.endswith("controls"))
        return _blanked(got, a) if b.endswith("blanks") else got
    if a in _MULTI or b in _MULTI:
        return _recode(text, a, b)
    return text.translate(_table(a, b)[0])


def search(text: str) -> Way:
    """The cheapest way from ``text``; those of short texts are kept, as words come again."""
    return _kept(text) if len(text) <= 200 else _search(text)


@lru_cache(maxsize=50_000)
def _kept(text: str) -> Way:
    return _search(text)


def _search(text: str) -> Way:
    begin = judge(text)
    best, best_total, best_worst = Way(), begin[0], begin[1]
    limit = begin[0] - MARGIN
    seen = {hash(text)}
    # (total, order, depth, text, ops, paid, costs, charsets of a step that waits)
    heap: list = [(begin[0], 0, 0, text, (), 0.0, begin, None)]
    order = expanded = 0
    while heap:
        total, _, depth, now, ops, paid, costs, wait = heapq.heappop(heap)
        if best.ops and best_worst <= PLAUSIBLE and (total > best_total or total == best_total and best_worst <= SOUND):
            if wait is not None or paid + CHEAPEST >= best.paid:
                continue  # a plausible text is known; only shorter ways are still of interest
        if wait is not None:  # its turn has come
            got = now.translate(_table(*wait)[0])
            if (key := hash(got)) in seen:
                continue
            seen.add(key)
            costs = judge(got)
            total = costs[0] + paid
            if total < best_total - 1e-9:
                best, best_total, best_worst = Way(ops, paid), total, costs[1]
            if total < begin[0] + WORSE:
                order += 1
                heapq.heappush(heap, (total, order, depth, got, ops, paid, costs, None))
            continue
        if depth == DEPTH:
            continue
        if expanded == EXPANSIONS:
            best.cut = True
            break
        expanded += 1
        for name, got, price, pair in _steps(now):
            order += 1
            if pair is not None:
                if price + paid < limit:
                    heapq.heappush(heap, (price + paid, order, depth + 1, now, (*ops, name), paid + pair[2], None, pair[:2]))
                continue
            if (key := hash(got)) in seen:
                continue
            seen.add(key)
            costs = judge(got)
            total = costs[0] + paid + price
            if total < best_total - 1e-9:
                best, best_total, best_worst = Way((*ops, name), paid + price), total, costs[1]
            if total < begin[0] + WORSE or name == "unescape":
                heapq.heappush(heap, (total, order, depth + 1, got, (*ops, name), paid + price, costs, None))
    return best


_CUTS = (re.compile(r"(\n+|(?<=>)(?=<))"), re.compile(r"((?<=[.!?;:>]) +)"), re.compile(r"((?<![^\x00-\x7f]) +)"))


class _Repair:
    """Repairs one text; ways taken once are cheaper for its other passages."""

    def __init__(self) -> None:
        self.ways: set[tuple[str, ...]] = set()
        self.cut = False

    def mend(self, text: str, level: int = 0) -> tuple[str, float, list[str]]:
        """(text, nats saved beyond the price, ways)."""
        bare = _unescape(text) if "&" in text else text
        begin = model().judge(bare)
        if begin[1] <= SOUND:
            return text, 0.0, []
        doubtful = " ".join(model().doubtful(bare, DOUBT)) + " "
        way = search(doubtful)
        got, gain, share = text, 0.0, 1.0
        if way.ops:
            got = bare
            for op in way.ops:
                got = got and _again(op, got)
            if got:
                after = judge(got)
                share = AGAIN if way.ops in self.ways else 1.0
                gain = begin[0] - after[0] - way.paid * share
        ways = [" | ".join(way.ops)]
        whole = bool(got) and got != text and gain >= MARGIN * share and after[1] <= PLAUSIBLE
        if whole and (after[1] <= SOUND or level == len(_CUTS)):
            self.ways.add(way.ops)
            return got, gain, ways
        if level == len(_CUTS):
            self.cut |= way.cut
            return text, 0.0, []
        saved, used, out = 0.0, [], []
        for p in _CUTS[level].split(text):
            part, more, ops = self.mend(p, level + 1) if not p.isascii() or "&" in p else (p, 0.0, [])
            saved += more
            used += ops
            out.append(part)
        if whole and gain >= saved:
            self.ways.add(way.ops)
            return got, gain, ways
        return "".join(out), saved, used


def restore(text: str | None) -> tuple[str | None, bool, str, bool]:
    """(restored text, affected, operations that were used, whether a search was cut short)."""
    if not text or text.isascii() and "&" not in text:
        return text, False, "", False
    r = _Repair()
    got, _, ways = r.mend(text)
    return got, got != text or LOST in text, " ; ".join(dict.fromkeys(ways)), r.cut


_OUT = "id {}, restored string, affected boolean, operations string, cut boolean"


def _map(df: DataFrame, id_col: str, text_col: str, all_rows: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.bool_(), pa.string(), pa.bool_())
        for b in batches:
            for lo, hi in slices(b.column(1)):
                part = b.slice(lo, hi - lo)
                got = [restore(t) for t in part.column(1).to_pylist()]
                keep = [i for i, g in enumerate(got) if all_rows or g[1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep, pa.int64())), *(pa.array([got[i][k] for i in keep], t) for k, t in enumerate(types))],
                    names=["id", "restored", "affected", "operations", "cut"],
                )

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not all_rows:  # plain ASCII without references cannot be affected
        rows = rows.where(F.col("text").rlike("[^\\x00-\\x7F]|&[A-Za-z#]"))
    return rows.mapInArrow(run, _OUT.format(kind))


def affected(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored, operations, cut) of the texts that were misread; one row per id."""
    return _map(df, id_col, text_col, False).drop("affected").dropDuplicates(["id"])


def restored(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored, affected, operations, cut) of every row."""
    return _map(df, id_col, text_col, True)
