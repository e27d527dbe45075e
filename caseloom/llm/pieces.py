"""Cutting oversized texts at natural boundaries, with overlap, by pointer doubling.

A text's words (as its tokenizer cuts them) are atoms; a word of more than ``LONG``
tokens is cut into runs of characters that are atoms themselves.  Between atoms stand
boundaries of a strength: 5 blank line, 4 line end, 3 sentence end, 2 clause end,
1 between words, 0 inside a word.

* From every boundary the farthest legal piece end is found at once (binary search over
  cumulative token counts): the farthest boundary within the limit that is a sentence
  end or stronger; if there is none that makes progress, the farthest clause end, then
  word end, then any.  The next piece starts at the last boundary that repeats at least
  ``overlap`` tokens.  That is each boundary's successor.
* Squaring the successor table (J = J[J]) doubles the reach in each round, so that all
  greedy cuts of all texts of a batch are known after log2(pieces) rounds.

A piece's tokens are counted on the piece itself; where a cut changed the count so that
a piece exceeds the limit, the text is cut again with a limit lower by what was too much.

Defined results: texts within the limit, null and empty texts have no pieces; pieces
joined without their overlaps give the text; repeated rows are cut each; null ids are
kept.  A single character of more tokens than the limit allows stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.bpe import WORDS, ByteBpe, load, slices, tokenizer_dir

LONG = 16
RUN = 8
_SENTENCE = ".!?…。！？؟।"
_CLAUSE = ",;:，；：、–—"
_WIDE_END = "。！？"
_CLOSE = "\"'”’»)]}*_"


#: What the cutter has to know of a word: white space, line ends, strength after it,
#: whether it hands on the strength before it, whether it starts with white space,
#: whether a cut may follow it though no white space does.
_TRAITS = 6


def _traits(word: str) -> tuple[int, int, int, int, int, int]:
    if word.isspace():
        return 1, word.count("\n") or word.count("\r"), 0, 0, 1, 1
    last = (word.rstrip(_CLOSE) or word)[-1]
    level = 3 if last in _SENTENCE else 2 if last in _CLAUSE else 0
    return 0, 0, level, int(not word.strip(_CLOSE)), int(word[0].isspace()), int(last in _WIDE_END)


class Traits:
    """Traits of the words of a vocabulary, by word number; follows its word table."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.table, self.known, self.owner = bpe, np.zeros((0, _TRAITS), np.int16), 0, None

    def of(self, numbers: np.ndarray) -> np.ndarray:
        if self.owner is not self.bpe.index:  # the word table was emptied
            self.owner, self.known, self.table = self.bpe.index, 0, np.zeros((0, _TRAITS), np.int16)
        if self.known < len(self.bpe.index):
            fresh = list(self.bpe.index)[self.known :]
            self.table = np.concatenate([self.table, np.array([_traits(w) for w in fresh], np.int16)])
            self.known = len(self.bpe.index)
        return self.table[numbers]


def _atoms(bpe: ByteBpe, words: list[str], size: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Atoms, their tokens, and whether each is a run cut out of a long word."""
    if size.max(initial=0) <= LONG:
        return words, size, np.zeros(len(words), bool)
    out: list[str] = []
    cut: list[bool] = []
    for w, n in zip(words, size.tolist(), strict=True):
        runs = [w] if n <= LONG else [w[i : i + RUN] for i in range(0, len(w), RUN)]
        out.extend(runs)
        cut.extend([n > LONG] * len(runs))
    return out, bpe.word_sizes(out), np.array(cut)


def _strengths(t: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Strength of the boundary after each atom, from the atoms' traits.

    White space has the strength of the text before it, or of the line ends in it.  Closing
    marks right after a text have that text's strength.  A cut is free where white space
    follows or precedes, or after a full-width sentence end: "3.14" and "a.b" are not cut.
    """
    n = len(t)
    here = np.arange(n)
    space = t[:, 0] == 1
    after_space = np.append(True, space[:-1])
    hands_on = (t[:, 3] == 1) & ~after_space & (t[:, 4] == 0)
    source = np.maximum.accumulate(np.where(space | hands_on, -1, here))
    own = np.where(t[:, 3] == 1, 0, t[:, 2])
    level = np.where(source >= 0, own[np.maximum(source, 0)], 0)
    lines = np.cumsum(np.where(space, t[:, 1], 0))
    begin = np.maximum.accumulate(np.where(space & ~np.append(False, space[:-1]), here, -1))
    count = lines - np.where(begin > 0, lines[np.maximum(begin - 1, 0)], 0)
    level = np.where(space, np.maximum(level, np.where(count > 1, 5, np.where(count == 1, 4, 1))), level)
    free = np.append(t[1:, 4] == 1, True) | space | (t[:, 5] == 1)
    inside = np.append(cut[1:] & cut[:-1], False)
    return np.where(free & ~inside, np.maximum(level, 1), 0).astype(np.int8)


def _cut(cum: np.ndarray, end: np.ndarray, level: np.ndarray, limit: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece end, next start) of every boundary of a flat batch of texts.

    ``cum``: tokens before each boundary; ``end``: the last boundary of its text.
    """
    here = np.arange(len(cum))
    far = np.minimum(np.searchsorted(cum, cum + limit, "right") - 1, end)
    far = np.maximum(far, np.minimum(here + 1, end))
    done = far == end
    stop = np.full(len(cum), -1)
    for least in (3, 2, 1, 0):
        last = np.maximum.accumulate(np.where(level >= least, here, -1))[far]
        # progress: the piece must exceed what the next one repeats
        ok = (stop < 0) & (last > here) & (cum[np.maximum(last, 0)] - cum > overlap + 2 * LONG)
        stop = np.where(ok, last, stop)
    stop = np.where(done, end, np.where(stop < 0, far, stop))
    back = np.searchsorted(cum, cum[stop] - overlap, "right") - 1
    follow = np.where(done, end, np.where(back > here, back, stop))
    return stop, follow


def _starts(follow: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All boundaries that the greedy walks from ``first`` visit, by pointer doubling."""
    seen = np.zeros(len(follow), bool)
    seen[first] = True
    jump = follow
    while True:
        before = int(seen.sum())
        seen[jump[np.flatnonzero(seen)]] = True
        if int(seen.sum()) == before:
            return seen
        jump = jump[jump]


def cut_texts(
    bpe: ByteBpe, traits: Traits, texts: list[str], words: list[list[str]], limit: int, overlap: int
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text (given with its words): start and end characters, tokens and repeated tokens of its pieces.

    A piece's tokens are those of its atoms, but for white space at its end, which is
    one word there, and for runs of long words: these pieces are tokenized again.
    """
    atoms = [_atoms(bpe, w, bpe.word_sizes(w)) for w in words]
    out: list = [None] * len(texts)
    todo, limits = list(range(len(texts))), np.full(len(texts), limit)
    while todo:
        sizes = [atoms[i][1] for i in todo]
        n = np.array([len(x) for x in sizes])
        firsts = np.append(0, np.cumsum(n + 1))[:-1]
        gaps = np.zeros(int((n + 1).sum()), np.int64)
        within = np.ones(len(gaps), bool)
        within[firsts] = False  # boundary 0 of each text; texts stay apart in the cumulative counts
        gaps[within] = np.concatenate(sizes)
        gaps[firsts[1:]] = limit + 1
        cum = np.cumsum(gaps)
        flat = [a for i in todo for a in atoms[i][0]]
        number = np.fromiter(map(bpe.index.__getitem__, flat), np.int64, len(flat))
        t, cut = traits.of(number), np.concatenate([atoms[i][2] for i in todo])
        char = np.zeros(len(gaps), np.int64)
        char[within] = np.fromiter(map(len, flat), np.int64, len(flat))
        char = np.cumsum(char)
        char -= np.repeat(char[firsts], n + 1)
        end = np.repeat(firsts + n, n + 1)
        level = np.zeros(len(gaps), np.int8)
        level[within] = _strengths(t, cut)
        stop, follow = _cut(cum, end, level, np.repeat(limits[todo], n + 1), overlap)
        seen = _starts(follow, firsts)
        seen[np.unique(end)] = False
        at = np.flatnonzero(seen)
        owner = np.searchsorted(firsts, at, "right") - 1
        a, b = char[at], char[stop[at]]
        size = cum[stop[at]] - cum[at]
        # where the piece's own tokens may differ: white space at the end, runs of long words
        blank, runs = np.zeros(len(gaps), bool), np.zeros(len(gaps), np.int64)
        blank[within], runs[within] = t[:, 0] == 1, cut
        runs = np.cumsum(runs)
        doubt = (blank[stop[at]] & (stop[at] != end[at])) | (runs[stop[at]] > runs[at])
        whole = runs[stop[at]] > runs[at]
        for k in np.flatnonzero(doubt).tolist():
            piece = texts[todo[owner[k]]][a[k] : b[k]]
            if whole[k]:
                size[k] = bpe.sizes([piece])[0]
            else:
                tail = len(piece) - len(piece.rstrip())
                j = int(stop[at[k]])
                while blank[j] and j > at[k]:
                    j -= 1
                size[k] = cum[j] - cum[at[k]] + bpe.word_sizes([piece[len(piece) - tail :]])[0]
        new = np.append(True, owner[1:] != owner[:-1])
        shared = np.where(new, 0, np.append(0, cum[stop[at]][:-1]) - cum[at])
        lengths, again = b - a, []
        for k, i in enumerate(todo):
            mine = slice(*np.searchsorted(owner, [k, k + 1]))
            worst = int(np.where(lengths[mine] > 1, size[mine], 0).max(initial=0))
            if worst > limit and limits[i] > overlap + 3 * LONG:
                limits[i] = max(overlap + 3 * LONG, limits[i] - (worst - limit))
                again.append(i)
            else:
                out[i] = (a[mine], b[mine], size[mine], shared[mine])
        todo = again
    return out


SCHEMA = "piece int, start_char int, end_char int, n_tokens int, repeated_tokens int, text string"


def split_texts(
    df: DataFrame, id_col: str, text_col: str, limit: int = 512, overlap: int = 64,
    tokenizer: str = "byte_bpe_50k", folder: str | None = None,
) -> DataFrame:
    """(id, piece, start_char, end_char, n_tokens, repeated_tokens, text) of long texts.

    One map stage, no shuffle.  ``limit`` must exceed ``overlap`` by 64 or more.
    """
    if limit < overlap + 4 * LONG:
        raise ValueError("limit must exceed overlap by 64 tokens or more")
    path = f"{tokenizer_dir(df.sparkSession, folder)}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        traits = Traits(bpe)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                if len(bpe.index) >= WORDS:
                    bpe.clear()
                words = [bpe.find(x) for x in texts]
                n = np.array([len(w) for w in words])
                total = np.append(0, np.cumsum(bpe.word_sizes([w for ws in words for w in ws])))
                ends = np.cumsum(n)
                long = np.flatnonzero(total[ends] - total[ends - n] > limit).tolist()
                if not long:
                    continue
                cuts = cut_texts(bpe, traits, [texts[i] for i in long], [words[i] for i in long], limit, overlap)
                n = [len(c[0]) for c in cuts]
                rows = pa.array(np.repeat(np.array(long) + lo, n))
                cols = [np.concatenate([c[k] for c in cuts]).astype(np.int32) for k in range(4)]
                text = [texts[i][x:y] for i, c in zip(long, cuts, strict=True) for x, y in zip(c[0].tolist(), c[1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), pa.array(np.concatenate([np.arange(k) for k in n]).astype(np.int32)), *map(pa.array, cols), pa.array(text, pa.string())],
                    names=["id", "piece", "start_char", "end_char", "n_tokens", "repeated_tokens", "text"],
                )

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # a token has a byte at least: texts of no more bytes than the limit have no pieces
    return rows.where(F.octet_length("text") > limit).mapInArrow(run, f"id {kind}, {SCHEMA}")
