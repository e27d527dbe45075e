"""Byte-level BPE with a public vocabulary: batched numpy merge rounds.

A text is cut into words by the vocabulary's pattern.  Words not met before are merged
together: their symbols stand in one flat array, each round finds the rank of every
adjacent pair by binary search over the sorted pair keys, and merges, in every word, all
places of the word's lowest-ranked pair, from left to right.  Words that have no pair
left drop out.  Texts are then gathered from the words' ids without a loop over symbols.

The word table of a worker is emptied when it has ``WORDS`` words, so memory is bounded.
The vocabulary's folder is a parameter: argument, else the Spark setting
``caseloom.tokenizers``, else the environment's CASELOOM_TOKENIZERS, else
/opt/tokenizers.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 600_000
#: Characters of a batch that are tokenized at once.
CHARS = 4_000_000
#: Fixed value: the pattern that the byte-level vocabularies are defined with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_dir(spark: SparkSession, given: str | None = None) -> str:
    return given or spark.conf.get("caseloom.tokenizers", None) or os.environ.get("CASELOOM_TOKENIZERS", "/opt/tokenizers")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, by its public rule.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A vocabulary and the words it has been asked for."""

    def __init__(self, path: str):
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        before = file.get("pre_tokenizer") or {}
        if file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level vocabularies without a normalizer or a blank put before the text are encoded here")
        model = file["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.byte_id = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.find = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the number of ids of each word."""
        size = np.array([len(x) for x in raw], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        done_sym, done_word = [], []
        none = np.int64(len(self.keys))
        while len(sym):
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(sym)))
            over = np.repeat(low == none, span)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                keep = ~over
                sym, word, rank = sym[keep], word[keep], rank[keep]
                low, span = low[low != none], span[low != none]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, span)
            # of overlapping places (x x x) only the 1st, 3rd, ... of a run are merged
            where = np.flatnonzero(hit)
            head = np.append(True, np.diff(where) > 1)
            head_at = np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - head_at) % 2 == 0]
            sym = sym.copy()
            sym[where] = self.merged[rank[where]]
            stay = np.ones(len(sym), bool)
            stay[where + 1] = False
            sym, word = sym[stay], word[stay]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(raw), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(raw))

    def learn(self, found: list[str]) -> None:
        """Merges the words that are not known yet."""
        fresh = list(set(found).difference(self.index))
        if not fresh:
            return
        known = len(self.start)
        flat, size = self.merge([w.encode("utf-8", "replace") for w in fresh])
        self.start = np.append(self.start, np.cumsum(np.append(0, size[:-1])) + len(self.flat))
        self.length = np.append(self.length, size)
        self.flat = np.append(self.flat, flat)
        self.index.update(zip(fresh, range(known, known + len(fresh)), strict=True))

    def word_sizes(self, words: list[str]) -> np.ndarray:
        """Number of ids of each word."""
        self.learn(words)
        return self.length[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in one flat array, and the words of each text.

        Lone surrogates, which no table can hold, would be encoded as question marks.
        """
        if len(self.index) >= WORDS:
            self.clear()
        found: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        find = self.find
        for i, t in enumerate(texts):
            if t:
                ws = find(t)
                counts[i] = len(ws)
                found.extend(ws)
        self.learn(found)
        return np.fromiter(map(self.index.__getitem__, found), np.int64, len(found)), counts

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text (0 for null and empty texts)."""
        w, counts = self.words(texts)
        total = np.append(0, np.cumsum(self.length[w]))
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and offsets (one more than texts)."""
        w, counts = self.words(texts)
        size = self.length[w]
        total = np.append(0, np.cumsum(size))
        ids = self.flat[np.repeat(self.start[w] - total[:-1], size) + np.arange(total[-1])] if len(w) else np.zeros(0, np.int32)
        return ids, total[np.append(0, np.cumsum(counts))]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHARS`` bytes of text, each of one row at least."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0))
    total, at = np.cumsum(size), 0
    while at < len(size):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + CHARS, "right")))
        yield at, end
        at = end


def encode_texts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every row, without special tokens.

    Null and empty texts have the empty list; strings of special tokens are ordinary
    text; rows are kept as they are, repeated ones too; one map stage, no shuffle.
    """
    path = f"{tokenizer_dir(df.sparkSession, folder)}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                ids, offsets = bpe.encode(b.column(1).slice(lo, hi - lo).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], names=["id", "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, ids array<int>"
    )


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row; null and empty texts have 0.  One map stage."""
    path = f"{tokenizer_dir(df.sparkSession, folder)}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                n = bpe.sizes(b.column(1).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long"
    )
