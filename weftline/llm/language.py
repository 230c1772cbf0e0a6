"""Language identification: words first, character n-grams as back-off.

Training counts words per language over documents whose lang is known.  Each language uses documents of about SAMPLE
characters, chosen by a hash of doc_id; all their words and n-grams are counted and kept, so the model's size is bounded by
the sample and no language loses its own words to another.  A known word scores its log frequency in each language; an
unseen one scores the mean of its longest known n-grams, from N letters down to one.

Words are runs of letters (Unicode categories L) of the lower-cased text, however long.  Defined results: null texts and
texts without a letter, empty ones too, are `und` with score 0; without training rows every text is `und`; texts of any
length count whole; repeated rows are scored one by one; equal scores (ties) go to the first language by name; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialise, table, tidied

SAMPLE, N = 2_000_000, 4
#: So many words are remembered with their values; of those over CACHED letters, CACHED * REMEMBERED letters in all.
CACHED, REMEMBERED = 40, 200_000


def _letters() -> re.Pattern[str]:
    """Runs of characters that are letters to Unicode, as one class of ranges."""
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        letter = c <= sys.maxunicode and chr(c).isalpha()
        if letter and start is None:
            start = c
        elif not letter and start is not None:
            ranges.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return re.compile(f"[{''.join(ranges)}]+")


_WORD = _letters()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over docs with lang and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.update((lang, w) for w in _WORD.findall((text or "").lower()))
            rows = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([out[r] for r in rows], pa.int64())], ["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(tidied(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sample_of(docs: DataFrame, characters: int) -> DataFrame:
    """Documents of about so many characters of each language, by a hash of doc_id."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), "text", "doc_id").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    if not sizes:
        return docs
    share = F.create_map(*[F.lit(x) for k, v in sorted(sizes.items()) for x in (k, int(min(1.0, characters / max(1, v)) * (1 << 30)))])
    return docs.where(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")])


def grams(word: str, n: int) -> Iterator[str]:
    w = f"^{word}$" if n > 1 else word
    return (w[i : i + n] for i in range(len(w) - n + 1))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, size, gram, n over counted words; size 0 are the words themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: Counter = Counter()
            for lang, word, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                for size in range(1, N + 1):
                    for x in grams(word, size):
                        out[lang, size, x] += n
            rows = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([out[r] for r in rows], pa.int64())], ["lang", "size", "gram", "n"])

    counted = words.select("lang", "word", "n").mapInArrow(tidied(run), "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return counted.unionByName(words.select("lang", F.lit(0).alias("size"), F.col("word").alias("gram"), "n"))


class Backoff:
    """A gram's value in a language it was never seen in depends on its size only, so only languages that have it are stored.

    Values of words that texts hold are laid out in rows of a table as they come up; a batch of texts is scored by adding
    up rows of that table."""

    def __init__(self, rows: list[tuple[str, int, str, int]]) -> None:
        """rows: (lang, size, gram, n), size 0 for words."""
        totals: Counter = Counter()
        for lang, size, _, n in rows:
            totals[lang, size] += n
        self.langs = sorted({lang for lang, *_ in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        distinct = Counter(size for size, _ in {r[1:3] for r in rows})
        whole = np.array([[totals.get((x, size), 0) + 0.1 * (distinct.get(size, 0) + 1) for x in self.langs] for size in range(N + 1)]).reshape(N + 1, len(at))
        self.base = np.log(0.1 / whole)
        self.index: list[dict[str, int]] = [{} for _ in range(N + 1)]  # by size, words at 0
        rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
        starts, sizes = [], []
        for k, (_, size, x, _) in enumerate(rows):
            if not k or rows[k - 1][1:3] != (size, x):
                self.index[size][x] = len(starts)
                starts.append(k)
                sizes.append(size)
        self.start = np.array([*starts, len(rows)], np.int64)
        self.size = np.array(sizes, np.int8)
        self.lang = np.array([at[r[0]] for r in rows], np.int32)
        self.more = np.log(np.array([r[3] for r in rows], np.float64) / 0.1 + 1)
        self._rows: dict[str, int] = {}
        self._long = 0
        self._table = np.zeros((1024, len(self.langs)))

    def values(self, some: np.ndarray) -> np.ndarray:
        """Log shares of words or n-grams in each language."""
        out, n = self.base[self.size[some]], self.start[some + 1] - self.start[some]
        at = np.repeat(self.start[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(some)), n), self.lang[at]] += self.more[at]
        return out

    def _learn(self, words: list[str]) -> None:
        """Rows of the table for new words: a known word's value, or the mean of an unseen word's longest known n-grams."""
        first, n = len(self._rows), len(words)
        while first + n > len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        table = self._table[first : first + n]
        table[:] = 0
        known = np.array([self.index[0].get(w, -1) for w in words])
        table[known >= 0] = self.values(known[known >= 0])
        rows, counts, found = [], [], []
        for k in np.flatnonzero(known < 0).tolist():
            for size in range(N, 0, -1):
                get = self.index[size].get
                some = [i for x in grams(words[k], size) if (i := get(x)) is not None]
                if some:
                    rows.append(k)
                    counts.append(len(some))
                    found += some
                    break
        if rows:
            distinct, at = np.unique(np.array(found), return_inverse=True)
            sums = np.add.reduceat(self.values(distinct)[at], np.cumsum([0, *counts[:-1]]), axis=0)
            table[rows] = sums / np.array(counts)[:, None]
        self._rows.update(zip(words, range(first, first + n), strict=True))
        self._long += sum(len(w) for w in words if len(w) > CACHED)

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its probability for each text."""
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        some = [k for k, words in enumerate(found) if words]
        if not some or not self.langs:
            return best, score
        if len(self._rows) > REMEMBERED or self._long > CACHED * REMEMBERED:
            self._rows.clear()
            self._long = 0
        flat = list(chain.from_iterable(found))
        new = list(set(flat).difference(self._rows))
        if new:
            self._learn(new)
        rows = list(map(self._rows.__getitem__, flat))
        first = np.cumsum([0, *(len(found[k]) for k in some[:-1])])
        totals = np.add.reduceat(self._table[np.array(rows)], first, axis=0)
        top = totals.argmax(axis=1)
        share = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        for k, t, p in zip(some, top, share, strict=True):
            best[k], score[k] = self.langs[t], p
        return best, score

    def score(self, text: str | None) -> tuple[str, float]:
        best, score = self.scores([text])
        return best[0], float(score[0])


def train(docs: DataFrame, characters: int = SAMPLE) -> Backoff:
    counted = materialise(word_counts(sample_of(docs, characters)))
    rows = gram_counts(counted).toArrow()  # what the sample holds
    return Backoff(list(zip(*(rows[k].to_pylist() for k in ("lang", "size", "gram", "n")), strict=True)))


def apply(docs: DataFrame, model: Backoff) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE characters of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                best, score = m.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(4, 2)))
    return apply(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": query}
ORACLES: dict[str, str] = {}
