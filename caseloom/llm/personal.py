"""Personal information in free text: a semi-Markov conditional random field.

Segments are spans of tokens.  A label fixes what tokens a segment may have (numbers of
digit groups, runs of capital words, words around a house number, what stands around an
at sign); of such runs every span up to a stated length is a candidate, so the field
itself chooses the boundaries.  Features look at the whole segment: shape and grouping of
the digits, check digits, name lists, beginnings and endings of the words, what the run
goes on with on either side, and the words before and after.  The score of a segmentation
adds up its segments and the transitions between labels (outside, or the segment right
before); dynamic programming over the segments' ends finds the best one.

All weights start at zero and are fitted by the field's likelihood (forward and backward
sums, AdaGrad) to ``TRAINING`` sentences that ``personal_training`` makes from frames,
short public name lists and at most ``SAMPLE`` rows of a directory (chosen by hash; a
documented bound).  The look-up of names uses the whole directory.

Defined results: null and empty texts have no entities and stay what they are; repeated
rows give one row per kind; null entries of address lists are skipped; extra columns are
ignored; whole texts of any length are read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import personal_training as pt
from caseloom.llm.bpe import slices

#: Directory rows used for fitting; sentences made and passes over them.
SAMPLE, TRAINING, PASSES = 1_000, 6_500, 4
#: Distinct names of a directory that are sent to every task; more are refused, not dropped.
LEXICON = 5_000_000
#: Step and pull towards zero of the fitting.
RATE, DECAY = 0.12, 0.03
KINDS = ("email", "phone", "national_id", "street", "name")
#: Longest segments: digit groups of a number, words of a name, words of a street.
GROUPS, NAME_WORDS, STREET_WORDS = 10, 5, 7
#: (start, end, label, features)
Span = tuple[int, int, str, tuple[str, ...]]

_WORDS = re.compile(r"[^\W_]+|[#№=:&]")
_BREAK = re.compile(r"[\n>|]")
_BLANKS = "    "


@lru_cache(maxsize=200_000)
def _low(word: str) -> str:
    return word.lower()


def _before(text: str, a: int) -> list[str]:
    """Up to four words before a place, nearest first; lines and tags end the view."""
    left = text[max(0, a - 48) : a]
    cut = max(left.rfind("\n"), left.rfind(">"))
    words = _WORDS.findall(left[cut + 1 :])[-4:]
    return [_low(w) for w in reversed(words)]


def _after(text: str, b: int) -> str:
    m = re.compile(r"[  ]*([^\W_]+|[^\w\s])").match(text, b)
    return _low(m[1]) if m and m[1] not in ".,;:!?)" else ""


def _edge(text: str, i: int) -> str:
    """The class of the character at ``i``."""
    if i < 0 or i >= len(text):
        return "end"
    c = text[i]
    return "a" if c.isalpha() else "d" if c.isdigit() else " " if c in _BLANKS else c


# ---- mailboxes ----------------------------------------------------------------
_AT = re.compile(r"@|＠|&#0*64;|&commat;|%40|[\[({<] ?(?:at|AT|At|arroba|arobase) ?[\])}>]| (?:AT|arroba|arobase|at) (?=[\w-]+(?: ?[\[(]? ?(?:dot|DOT|punto|point|punkt|ponto)\b))")
_DOMAIN = re.compile(r"\s?[^\W_][\w-]*(?:(?:[.．]| ?[\[({]? ?(?:dot|DOT|Dot|punto|point|punkt|ponto) ?[\])}]? ?)[^\W_][\w-]*)+")


def _mailboxes(text: str, out: list[Span]) -> None:
    for m in _AT.finditer(text):
        a = m.start()
        if a and text[a - 1].isspace():
            a -= 1
        at = a
        while a and (text[a - 1].isalnum() or text[a - 1] in "_.+-'’"):
            a -= 1
        while a < at and text[a] in "-'’.":
            a += 1
        domain = _DOMAIN.match(text, m.end()) if a < at and (text[at - 1].isalnum() or text[at - 1] in "_+") else None
        if domain:
            form = m[0].strip(" [](){}<>").lower()
            feats = ("b", f"at={form}", f"L={_edge(text, a - 1)}", f"ll={text[max(0, a - 2) : a]}", f"gap={at - m.start()}", f"dots={'.' in domain[0] or '．' in domain[0]}", f"head={text[a : a + 1].isalnum()}")
            out.append((a, domain.end(), "email", feats))


# ---- numbers --------------------------------------------------------------------
_RUN = re.compile(r"\d(?:[\d ().\-/–  ‑]*\d)?")
_DIGITS = re.compile(r"\d+")
_ODD = re.compile(
    r"(?P<ip>(?:\d{1,3}\.){3}\d{1,3})$|(?P<ymd>(?:19|20)\d\d([-/.])\d\d?\3\d\d?)$|(?P<dmy>\d\d?([-/.])\d\d?\5(?:19|20)\d\d)$|(?P<sum>\d{1,3}(?:[.,]\d{3})+(?:[.,]\d\d)?)$"
)
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _checks(d: str, lettered: str = "") -> list[str]:
    """National check digits that hold."""
    got = []
    n = len(d)
    if lettered:
        core = lettered[:-1].translate(str.maketrans("XYZ", "012"))
        if len(lettered) == 9 and core.isdigit():
            got.append("dni+" if _DNI[int(core) % 23] == lettered[-1] else "dni-")
        if re.match(r"[A-Z]{2}\d{6}[A-D]$", lettered):
            got.append("nino")
        if re.match(r"[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]$", lettered):
            got.append("fiscale")
        if re.match(r"\d{8}[A-Z]\d{3}$", lettered):
            got.append("svnr")
        return got
    if n == 15 and d[0] in "12":
        got.append("nir+" if 97 - int(d[:13]) % 97 == int(d[13:]) else "nir-")
    elif n == 11:
        p = 10
        for c in d[:10]:
            p = ((int(c) + p) % 10 or 10) * 2 % 11
        if (11 - p) % 10 == int(d[10]):
            got.append("steuer")
        a = sum(int(c) * w for c, w in zip(d[:9], range(10, 1, -1), strict=True)) * 10 % 11 % 10
        b = sum(int(c) * w for c, w in zip(d[:10], range(11, 1, -1), strict=True)) * 10 % 11 % 10
        if [a, b] == [int(d[9]), int(d[10])]:
            got.append("cpf")
        if sum(int(c) * w for c, w in zip(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3, 1), strict=True)) % 10 == 0:
            got.append("pesel")
    elif n == 10 and (11 - sum(int(c) * w for c, w in zip(d[:9], range(10, 1, -1), strict=True)) % 11) % 11 == int(d[9]):
        got.append("mod11")
    elif n == 16 and sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(d)) % 10 == 0:
        got.append("card")
    return got


def _context(text: str, a: int, b: int) -> list[str]:
    words = _before(text, a)
    feats = ["mark=" + words[0]] if words and words[0] in "#№=:&" else []
    words = [w for w in words if w not in "#№=:&"]
    feats += [f"w={w}" for w in set(words)]
    if words:
        feats += [f"w1={words[0]}", f"w1e={words[0][-6:]}"]
    else:
        feats.append("w0")
    if len(words) > 1:
        feats.append(f"w2={words[1]}_{words[0]}")
    if after := _after(text, b):
        feats.append(f"r1={after}")
    return feats


def _gap(s: str) -> str:
    return s if len(s) < 3 else "~"


def _numbers(text: str, out: list[Span], kinds: frozenset[str]) -> None:
    for m in _RUN.finditer(text):
        whole, at = m[0], m.start()
        if len(whole) < 5:
            continue
        groups = [(at + g.start(), at + g.end()) for g in _DIGITS.finditer(whole)]
        n = len(groups)
        for i in range(n):
            total = 0
            for j in range(i, min(n, i + GROUPS)):
                total += groups[j][1] - groups[j][0]
                if total > 20 or j > i and groups[j][0] - groups[j - 1][1] > 3:
                    break
                if total >= 7:
                    _number(text, groups, i, j, total, out, kinds)
        if "national_id" in kinds and sum(b - a for a, b in groups) >= 4:
            _lettered(text, groups, out)


def _number(text: str, groups: list[tuple[int, int]], i: int, j: int, total: int, out: list[Span], kinds: frozenset[str]) -> None:
    a, b = groups[i][0], groups[j][1]
    if i == 0:
        lead = 0
        while lead < 3 and a - lead > 0 and text[a - lead - 1] in "(+":
            lead += 1
        a -= lead
        if text.count("(", a, b) > text.count(")", a, b):  # a bracket around the number is not of it
            while a < groups[i][0] and text[a] == "(" and text.count("(", a, b) > text.count(")", a, b):
                a += 1
    elif text[groups[i][0] - 1] in "(+" :
        a -= 1
        if a and text[a - 1] == "(":
            a -= 1
        if text.count("(", a, b) != text.count(")", a, b):
            a = groups[i][0]
    if text[a : a + 1] != "(" and text.count(")", a, b) > text.count("(", a, b):
        return
    shape = text[a:b]
    d = "".join(text[x:y] for x, y in groups[i : j + 1])
    lead = "+" if "+" in shape[:2] else "00" if d.startswith("00") else "(" if shape[0] == "(" else "0" if d[0] == "0" else "1" if d[0] == "1" else ""
    lens = "-".join(str(y - x) for x, y in groups[i : j + 1])
    seps = "".join(sorted({c for x, y in zip(groups[i:j], groups[i + 1 : j + 1], strict=True) for c in text[x[1] : y[0]]}))
    odd = _ODD.match(shape)
    feats = ["b", f"n={total}", f"lead={lead}", f"g={lens}", f"lg={lead}|{lens}", f"ng={j - i + 1}", f"sep={seps}", f"ln={lead}|{total}", f"lns={lead}|{total}|{seps}", f"gs={lens}|{seps}"]
    if odd:
        feats.append(f"odd={odd.lastgroup}")
    if "email" not in kinds:
        feats.append("address")  # an entry of an address list
    feats += [f"chk={c}" for c in _checks(d)]
    left, right = _edge(text, a - 1), _edge(text, b)
    if i:
        feats.append(f"cutL={_gap(text[groups[i - 1][1] : groups[i][0]])}")
    elif left not in " (":
        feats.append(f"L={left}")
    if j + 1 < len(groups):
        feats.append(f"cutR={_gap(text[groups[j][1] : groups[j + 1][0]])}")
    elif right not in " .,;:)" or right == "." and _edge(text, b + 1) == "d":
        feats.append(f"R={right}" + (_edge(text, b + 1) if right in "-/." else ""))
    feats += _context(text, a, b)
    got = tuple(feats)
    if "phone" in kinds:
        out.append((a, b, "phone", got))
    if "national_id" in kinds:
        out.append((a, b, "national_id", got))


_TAIL = re.compile(r"([ \-]?)([A-Za-z])(?![^\W\d_])(?: ?\d{3}(?!\d))?")
_HEAD = re.compile(r"(?<![^\W_])([A-Za-z]{1,2})([ \-]?)$")
_CODE = re.compile(r"(?<![^\W_])(?=[A-Z\d]*[A-Z][A-Z\d]*[A-Z])(?=(?:[A-Z]*\d){5})[A-Z\d]{9,16}(?![^\W_])")


def _lettered(text: str, groups: list[tuple[int, int]], out: list[Span]) -> None:
    """Numbers with letters before or after them, of the whole run of groups and its ends."""
    n = len(groups)
    spans = {(0, n - 1)} if n <= 4 else {(0, k) for k in range(4)} | {(k, n - 1) for k in range(n - 4, n)}
    for i, j in spans:
        a, b = groups[i][0], groups[j][1]
        total = sum(y - x for x, y in groups[i : j + 1])
        if not 5 <= total <= 12:
            continue
        head = _HEAD.search(text, max(0, a - 4), a) if i == 0 else None
        tail = _TAIL.match(text, b) if j == n - 1 or text[b : b + 1].isalpha() else None
        for h in ({head, None} if head else {None}):
            for t in ({tail, None} if tail else {None}):
                if h is None and t is None:
                    continue
                x, y = h.start() if h else a, t.end() if t else b
                if _edge(text, x - 1) in "ad" or _edge(text, y) in "ad":
                    continue
                plain = re.sub(r"[^\dA-Za-z]", "", text[x:y]).upper()
                lens = "-".join(str(q - p) for p, q in groups[i : j + 1])
                form = re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", plain))
                feats = ["b", "lettered", f"form={form}", f"g={lens}", f"head={h[1].upper() if h and len(h[1]) == 1 else len(h[1]) if h else 0}", f"tail={bool(t)}", f"seps={h[2] if h else '~'}|{t[1] if t else '~'}|{form}", f"case={text[x:y].isupper()}"]
                feats += [f"chk={c}" for c in _checks("", plain)]
                feats += [f"{side}={e}" for side, e in (("L", _edge(text, x - 1)), ("R", _edge(text, y))) if e not in " .,;:)("]
                if i or j + 1 < n:
                    feats.append("cut")
                out.append((x, y, "national_id", (*feats, *_context(text, x, y))))


def _codes(text: str, out: list[Span]) -> None:
    for m in _CODE.finditer(text):
        form = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", m[0]))
        feats = ["b", "code", f"code={len(form)}|{form.count('A')}", f"codes={form[:2]}|{form[-2:]}", f"form={form}", *(f"chk={c}" for c in _checks("", m[0])), f"L={_edge(text, m.start() - 1)}", f"R={_edge(text, m.end())}"]
        out.append((*m.span(), "national_id", (*feats, *_context(text, *m.span()))))


# ---- streets ----------------------------------------------------------------------
_TYPES = frozenset(
    "street st road rd avenue ave lane ln boulevard blvd court ct drive dr square sq close way place pl row terrace crescent gardens parade hill walk mews grove quay rue av bd bld impasse allée allee chemin quai route cours passage sentier ruelle montée faubourg straße strasse weg platz gasse allee "
    "damm ufer ring steig markt chaussee calle c avda avenida plaza pza paseo camino ronda travesía carretera ctra glorieta rua travessa praça largo alameda via viale corso piazza vicolo ulica ul ulice улица ул проспект пр переулок пер бульвар straat laan plein gatan vägen gade vej".split()
)
_ENDINGS = ("straße", "strasse", "str", "gasse", "weg", "platz", "allee", "damm", "ufer", "ring", "steig", "markt", "chaussee", "straat", "laan", "gatan", "vägen", "gade", "vej", "hof")
_HOUSE = re.compile(r"(?<![\w.,/#@-])\d{1,4}[A-Za-z]?(?![\w%])")
_FORTH = re.compile(r"(?:[  ]?(?:bis|ter|quater)\b)?,?[  ]+((?:[^\W\d_][\w’'\-]*\.?[  ]+){0,6}[^\W\d_][\w’'\-]*\.?)")
_BACK = re.compile(r"((?:[^\W\d_][\w’'\-]*[./]?[  ,]+){0,6}[^\W\d_][\w’'\-]*[./]?),?[  ]*(?:(?:n\.?[ ]?[ºo°]|nº|num\.?|nr\.?|№|д\.)[ ]*)?$", re.I)
_WORD = re.compile(r"[^\W\d_](?:[\w’'\-]*\w)?")


def _type_of(word: str) -> str:
    low = _low(word)
    if low in _TYPES:
        return low
    for e in _ENDINGS:
        if len(low) > len(e) + 2 and low.endswith(e):
            return "-" + e
    return ""


def _streets(text: str, out: list[Span]) -> None:
    for m in _HOUSE.finditer(text):
        a, b = m.span()
        f = _FORTH.match(text, b)
        if f:
            words = [(w.start(), w.end(), w[0]) for w in _WORD.finditer(text, f.start(1), f.end(1))]
            types = [_type_of(w[2]) for w in words[:STREET_WORDS]]
            if any(types):
                for j in range(1, len(types)):
                    if types[0] or types[j]:
                        front = bool(types[0])
                        t = types[0] if front else types[j]
                        _street(text, a, words[j][1], f"{'front' if front else 'last'}", t, [w[2] for w in words[: j + 1]], out)
        left = text[max(0, a - 80) : a]
        cut = max(left.rfind("\n"), left.rfind(">"), left.rfind(": ") + 1 if ": " in left else -1, left.rfind("; ") + 1 if "; " in left else -1)
        base = max(0, a - 80) + cut + 1
        g = _BACK.search(left, cut + 1)
        if g:
            off = max(0, a - 80)
            words = [(off + w.start(), off + w.end(), w[0]) for w in _WORD.finditer(left, g.start(1), g.end(1))][-STREET_WORDS:]
            types = [_type_of(w[2]) for w in words]
            for i in range(len(words)):
                if words[i][0] >= base and types[i] and not (len(words) - i == 1 and types[i][0] != "-"):
                    _street(text, words[i][0], b, "worded" if types[i][0] != "-" else "joined", types[i], [w[2] for w in words[i:]], out)
                if i + 1 < len(words) and types[-1] and not types[i]:  # Lange Straße 5, Am Markt 2
                    if len(words) - i == 2:
                        _street(text, words[i][0], b, "pair", types[-1], [w[2] for w in words[i:]], out)


def _street(text: str, a: int, b: int, form: str, kind: str, words: list[str], out: list[Span]) -> None:
    capital = sum(w[:1].isupper() for w in words)
    feats = ["b", f"form={form}", f"type={kind}", f"ft={form}|{kind}", f"n={len(words)}", f"cap={capital == len(words)}", f"caps={form}|{min(capital, 3)}|{words[0][:1].isupper()}|{words[-1][:1].isupper()}", f"tcap={form}|{[w for w in words if _type_of(w)][0][:1].isupper()}"]
    feats += [f"in={_low(w)}" for w in words if w[:1].islower() and not _type_of(w)]
    left = _before(text, a)
    feats += [f"w1={left[0]}" if left else "w0", f"r1={_after(text, b)}", f"R={_edge(text, b)}"]
    if form == "front":
        nxt = re.compile(r"[  ]+([^\W\d_])").match(text, b)
        feats.append("more" if nxt and nxt[1].isupper() else "lower" if nxt else "stop")
        feats.append(f"end={len(words[-1]) < 4}")
    out.append((a, b, "street", tuple(feats)))


# ---- names --------------------------------------------------------------------------
_PART = r"(?:de|del|della|der|den|des|du|da|das|do|dos|di|van|von|vom|zu|bin|bint|ibn|al|el|la|le|y|e|ten|ter|af|av)"
_CAP = r"[^\W\d_a-zß-öø-ÿа-яё](?:[^\W\d_]|[’'\-](?=[^\W\d_]))*"
_RUNS = re.compile(rf"(?<![\w@＠.+/&-])(?<!\w[’']){_CAP}\.?(?:(?:,[ \u00a0]|[ \u00a0\u202f]{{1,2}}(?:{_PART}[ \u00a0]){{0,2}}){_CAP}\.?)+")
_TOKEN = re.compile(r"[^\W\d_](?:[\w’'\-]*\w)?")


@lru_cache(maxsize=200_000)
def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if c.isalpha())


class Names:
    """Given and family names that are known: those of the short lists and of a whole directory."""

    def __init__(self, people: list[tuple[str | None, str | None]]):
        self.given = {_plain(w) for g, _ in people if g for w in (g, *g.replace("-", " ").split())} - {""}
        self.family = {_plain(w) for _, f in people if f for w in (f, *f.split())} - {""}
        self.common_given, self.common_family = {_plain(g) for g in pt.GIVEN}, {_plain(f) for f in pt.FAMILY}
        self.seen: dict[str, tuple[str, ...]] = {}

    def features(self, word: str) -> tuple[str, ...]:
        """Lists the word is on, its shape, and its beginning and endings."""
        got = self.seen.get(word)
        if got is None:
            w = _plain(word)
            if len(w) == 1:
                kind = "i"
            else:
                kind = ("g" if w in self.given or w in self.common_given else "") + ("f" if w in self.family or w in self.common_family else "") or "u"
            shape = "X" if word.isupper() and len(w) > 1 else "Xx"
            got = (kind, f"k={kind}", f"s3={w[-3:]}", f"s4={w[-4:]}", f"p3={w[:3]}", f"w={w}", f"sh={shape}", f"len={min(len(w), 9)}")
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = got
        return got


def _names(text: str, names: Names, out: list[Span]) -> None:
    for m in _RUNS.finditer(text):
        tokens = [(t.start(), t.end(), t[0]) for t in _TOKEN.finditer(text, *m.span())]
        big = [k for k, t in enumerate(tokens) if t[2][0].isupper()]
        n = len(big)
        if n < 2:
            continue
        feats = {k: names.features(tokens[k][2]) for k in big}
        for p in range(n - 1):
            for q in range(p + 1, min(n, p + NAME_WORDS)):
                i, j = big[p], big[q]
                if j - i >= NAME_WORDS + 2:
                    break
                a, b = tokens[i][0], tokens[j][1]
                inner = text[a:b]
                commas = inner.count(",")
                last = tokens[big[q - 1]]
                if commas > 1 or text[last[1] : last[1] + 1] == "." and last[1] - last[0] > 2:
                    break  # a sentence ends there
                kinds = [feats[big[x]][0] for x in range(p, q + 1)]
                if kinds[-1] == "i" or commas and any(kinds[x - p] == "i" and text[tokens[big[x]][1] : tokens[big[x]][1] + 1] != "." for x in range(p, q + 1)):
                    continue
                many = q - p + 1
                got = ["b", f"n={many}", f"ks={','.join(kinds)}" if many < 4 else "ks=long", f"comma={commas}|{many}|{feats[i][6]}", f"u={kinds.count('u')}|{many}", "shapes=" + ",".join(feats[big[x]][6][3:] for x in range(p, min(q + 1, p + 3)))]
                for x in range(p, q + 1):
                    role = "F" if x == p else "Z" if x == q else "M"
                    got += [f"{role}:{f}" for f in feats[big[x]][1:]]
                    got.append("A:" + feats[big[x]][5])
                if j - i + 1 > many:
                    got.append("part")
                if inner.isupper():  # a run of capitals is a heading more often the longer it is
                    got.append(f"caps={min(n, 8)}|{many}")
                if p:
                    prev = feats[big[p - 1]]
                    got += [f"goL={prev[0]}", f"goL:{prev[5]}"]
                else:
                    left = _before(text, a)
                    got += [f"w1={left[0]}" if left else "w0", f"w2={left[1]}_{left[0]}" if len(left) > 1 else "w00"]
                if q + 1 < n and big[q + 1] == j + 1:
                    nxt = feats[big[q + 1]]
                    got += [f"goR={nxt[0]}", f"goR:{nxt[5]}", f"goR:{text[tokens[j][1] : tokens[j + 1][0]].strip()}"]
                else:
                    got.append(f"r1={_after(text, b)}")
                    got.append(f"R={_edge(text, b)}")
                out.append((a, b, "name", tuple(got)))


def candidates(text: str, names: Names, kinds: frozenset[str]) -> list[Span]:
    """Candidate segments with their features, by end."""
    out: list[Span] = []
    if "email" in kinds:
        _mailboxes(text, out)
    if kinds & {"phone", "national_id"}:
        _numbers(text, out, kinds)
    if "national_id" in kinds:
        _codes(text, out)
    if "street" in kinds:
        _streets(text, out)
    if "name" in kinds:
        _names(text, names, out)
    out.sort(key=lambda s: (s[1], s[0]))
    return out


# ---- the field ------------------------------------------------------------------------
class Field:
    """Weights of a label's features, and of its transition from ``O`` or from the segment right before."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {k: {} for k in KINDS}
        self.trans: dict[tuple[str, str], float] = {}

    def score(self, span: Span) -> float:
        w = self.w[span[2]]
        total = 0.0
        for f in span[3]:
            if f in w:
                total += w[f]
        return total

    def step(self, before: str, label: str) -> float:
        return self.trans.get((before, label), 0.0)


def _joints(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """For each span how many spans end before the word right before it, and how many before its start.

    Spans between the two numbers are its neighbours: nothing but blanks and signs parts them.
    """
    ends = [s[1] for s in spans]
    out = []
    for s in spans:
        at = s[0]
        while at and not text[at - 1].isalnum() and s[0] - at < 40:
            at -= 1
        out.append((bisect_right(ends, at - 1), bisect_right(ends, s[0])))
    return out


def decode(text: str, spans: list[Span], field: Field) -> list[Span]:
    """The segmentation of greatest score: spans kept, all else outside."""
    if not spans:
        return []
    joints = _joints(text, spans)
    best, value, back = [(0.0, -1)], [], []  # best of the first k spans: (score, last span)
    for k, s in enumerate(spans):
        far, near = joints[k]
        label = s[2]
        top, last = best[far][0] + field.step("O", label), best[far][1]
        for j in range(far, near):
            if spans[j][1] <= s[0] and value[j] + field.step(spans[j][2], label) > top:
                top, last = value[j] + field.step(spans[j][2], label), j
        value.append(top + field.score(s))
        back.append(last)
        best.append((value[k], k) if value[k] > best[-1][0] else best[-1])
    out, k = [], best[-1][1]
    while k >= 0:
        out.append(spans[k])
        k = back[k]
    return out[::-1]


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def marginals(text: str, spans: list[Span], field: Field) -> tuple[list[float], dict[tuple[str, str], float]]:
    """Probability of each span and of each transition, by forward and backward sums."""
    n = len(spans)
    joints = _joints(text, spans)
    own = [field.score(s) for s in spans]
    total, alpha = [0.0], []  # total[k]: all segmentations by the first k spans
    for k, s in enumerate(spans):
        far, near = joints[k]
        x = total[far] + field.step("O", s[2])
        for j in range(far, near):
            x = _logadd(x, alpha[j] + field.step(spans[j][2], s[2]))
        alpha.append(x + own[k])
        total.append(_logadd(total[-1], alpha[k]))
    beta = [0.0] * n
    followers: list[list[int]] = [[] for _ in range(n)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]  # spans whose far count is k
    for k in range(n):
        starts[joints[k][0]].append(k)
        for j in range(*joints[k]):
            followers[j].append(k)
    # by falling end; spans that may follow span k at a distance are those with far > k
    later = -math.inf
    suffix = [-math.inf] * (n + 2)
    for k in range(n - 1, -1, -1):
        for m in starts[k + 1]:
            later = _logadd(later, own[m] + field.step("O", spans[m][2]) + beta[m])
        suffix[k + 1] = later
        x = _logadd(0.0, later)
        for m in followers[k]:
            x = _logadd(x, own[m] + field.step(spans[k][2], spans[m][2]) + beta[m])
        beta[k] = x
    z = total[-1]
    probs = [math.exp(alpha[k] + beta[k] - z) for k in range(n)]
    moves: dict[tuple[str, str], float] = defaultdict(float)
    for k, s in enumerate(spans):
        far, near = joints[k]
        joined = 0.0
        for j in range(far, near):
            p = math.exp(alpha[j] + field.step(spans[j][2], s[2]) + own[k] + beta[k] - z)
            moves[spans[j][2], s[2]] += p
            joined += p
        moves["O", s[2]] += probs[k] - joined
    return probs, moves


ADDRESS_KINDS = frozenset(("phone", "name"))
_ALL = frozenset(KINDS)


def fit(names: Names, people: list[tuple[str, str]], texts=None) -> Field:
    """Weights from zero, by the likelihood of labelled sentences (AdaGrad with decay)."""
    field = Field()
    data = []
    for text, address, gold in texts or pt.labelled(people, 11, TRAINING, None):
        spans = candidates(text, names, ADDRESS_KINDS if address else _ALL)
        if spans:
            kept = {s[:3] for s in spans} & gold
            data.append((text, spans, kept))
    square: dict[tuple[str, str], float] = defaultdict(float)
    rate, decay = RATE, DECAY
    for _ in range(PASSES):
        for text, spans, gold in data:
            probs, moves = marginals(text, spans, field)
            for s, p in zip(spans, probs, strict=True):
                push = (s[:3] in gold) - p
                if abs(push) < 2e-3:
                    continue
                w = field.w[s[2]]
                for f in s[3]:
                    g = square[s[2], f] = square[s[2], f] + push * push
                    old = w.get(f, 0.0)
                    w[f] = old + rate * (push - decay * old) / math.sqrt(g + 0.1)
            true = _moves(text, spans, gold)
            for t in {*moves, *true}:
                push = true.get(t, 0.0) - moves.get(t, 0.0)
                g = square[t] = square[t] + push * push
                field.trans[t] = field.trans.get(t, 0.0) + 0.1 * push / math.sqrt(g + 0.1)
    for k in KINDS:  # what weighs next to nothing need not be carried
        field.w[k] = {f: x for f, x in field.w[k].items() if abs(x) > 0.01}
    return field


def _moves(text: str, spans: list[Span], gold: set) -> dict[tuple[str, str], float]:
    joints = _joints(text, spans)
    out: dict[tuple[str, str], float] = defaultdict(float)
    for k, s in enumerate(spans):
        if s[:3] in gold:
            near = [j for j in range(*joints[k]) if spans[j][:3] in gold]
            out[spans[near[-1]][2] if near else "O", s[2]] += 1.0
    return out


Model = tuple[Names, Field]


def find_entities(text: str, names: Names, field: Field, address: bool = False) -> list[Span]:
    """Entities of a text, or (``address``) of an entry of an address list."""
    return decode(text, candidates(text, names, ADDRESS_KINDS if address else _ALL), field)


PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}


def mask(text: str, names: Names, field: Field, address: bool = False) -> str:
    """The text with every entity replaced by the placeholder of its kind.

    In an address entry the mailbox itself stays (a phone number in it does not), as
    addresses are the entry's point.
    """
    out, at = [], 0
    for a, b, kind, _ in find_entities(text, names, field, address):
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


_FITTED: dict[int, Model] = {}


def learned(directory: DataFrame, given: str, family: str) -> Model:
    """Names of the whole directory, and weights fitted with at most ``SAMPLE`` of its rows.

    The rows for fitting are those of the least hash.  A directory of more than
    ``LEXICON`` people is refused (it would be sent to every task).
    """
    rows = directory.select(F.col(given).alias("g"), F.col(family).alias("f")).distinct()
    got = rows.orderBy(F.xxhash64("g", "f"), "f", "g").limit(LEXICON + 1).collect()
    if len(got) > LEXICON:
        raise ValueError(f"a directory of more than {LEXICON} people is not sent to every task")
    people = [(r["g"], r["f"]) for r in got]
    key = hash(tuple(people))
    if key not in _FITTED:
        names = Names(people)
        _FITTED.clear()
        _FITTED[key] = names, fit(names, [(g, f) for g, f in people[:SAMPLE] if g and f])
    return _FITTED[key]


def _mapped(rows: DataFrame, model: Model, want: str) -> DataFrame:
    names, field = model
    names.seen.clear()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, field = shared.value
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                b = batch.slice(lo, hi - lo)
                places, ids, texts = b.column("place").to_pylist(), b.column("row_id"), b.column("text").to_pylist()
                at, kinds = [], []
                for i, (p, t) in enumerate(zip(places, texts, strict=True)):
                    if want == "text":
                        at.append(i)
                        kinds.append(mask(t, names, field, p != "text") if t else t)
                    elif t:
                        for k in {s[2] for s in find_entities(t, names, field, p != "text")}:
                            at.append(i)
                            kinds.append(k)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("place").take(take), ids.take(take), pa.array(kinds, pa.string())], names=["place", "row_id", want])

    return rows.select("place", F.col("row_id").cast("long").alias("row_id"), "text").mapInArrow(run, f"place string, row_id long, {want} string")


def found_kinds(rows: DataFrame, model: Model) -> DataFrame:
    """(place, row_id, kind), one row each, of ``rows`` (place, row_id, text).

    ``place`` is "text" for free text; anything else is an address list's entry.
    """
    some = rows.where("text is not null")
    return _mapped(some, model, "kind").distinct()


def masked(rows: DataFrame, model: Model) -> DataFrame:
    """(place, row_id, text) of every row, entities replaced by placeholders."""
    return _mapped(rows, model, "text")
