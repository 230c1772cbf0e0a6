"""Substring dedup with a compressed FM-index per shard.

A shard's index is the Burrows-Wheeler transform of its texts in a wavelet matrix over packed bit vectors, with rank by
block counts and popcounts, and common prefixes in one octet a symbol.  Texts of other documents and its own are streamed
through it by backward search, all of a batch in lockstep; that gives their matching statistics, capped at the window.
Places with a match of the whole window are reported with their interval, for which the index knows the least doc_id.

Query op9: words are maximal runs of bytes other than white space, windows have 50 words.  Words are compared by 64-bit
hashes.  Defined results: null and empty texts have no words and the hash of the empty string; repeated rows (same
doc_id) never remove each other, so of equal texts all rows with the least doc_id stay whole; a null doc_id comes after all
others; very long texts are cut into stretches, no word is left out; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .anchors import repeated_windows
from .common import sorted_suffixes, table

WINDOW, GRAM = 50, 16
#: Words in one index, and texts streamed through it together.
PART, STREAMED = 1 << 17, 4096


class BitVector:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.blocks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.blocks[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels, x = [], symbols
        self.bits = max(1, int(size - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            b = ((x >> level) & 1).astype(bool)
            self.levels.append((BitVector(b), int(len(b) - b.sum())))
            x = np.concatenate([x[~b], x[b]])
        # where each symbol's block begins at the last level
        self.start = self.descend(np.arange(size), np.zeros(size, np.int64))

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (v, zeros) in enumerate(self.levels):
            one = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            r = v.rank1(i)
            i = np.where(one, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before place i."""
        return self.descend(c, i) - self.start[c]


class CommonPrefixes:
    """Common prefixes of neighbouring suffixes, capped, one octet each, with minima of blocks for searches."""

    BLOCK = 64

    def __init__(self, values: np.ndarray) -> None:
        """values[k]: symbols that suffixes k - 1 and k share; both ends are 0."""
        self.values = values.astype(np.uint8)
        size = -(-len(values) // self.BLOCK) * self.BLOCK
        self.least = np.pad(self.values, (0, size - len(values)), constant_values=255).reshape(-1, self.BLOCK).min(axis=1)

    @staticmethod
    def _scan(values: np.ndarray, p: np.ndarray, below: np.ndarray, step: int) -> np.ndarray:
        """From each p on in direction `step`, the first place among BLOCK with a smaller value, or -1."""
        at = np.clip(p[:, None] + step * np.arange(CommonPrefixes.BLOCK), 0, len(values) - 1)
        hit = values[at] < below[:, None]
        k = hit.argmax(axis=1)
        return np.where(hit.any(axis=1), at[np.arange(len(p)), k], -1)

    def nearest(self, p: np.ndarray, below: np.ndarray, step: int) -> np.ndarray:
        """The nearest place from p on, in direction `step`, with a value under `below` (which is 1 at least)."""
        out = self._scan(self.values, p, below, step)
        todo = np.flatnonzero(out < 0)
        if len(todo):
            block = p[todo] // self.BLOCK + step  # what its own block holds on that side has been seen
            found = np.full(len(todo), -1)
            while (found < 0).any():
                k = np.flatnonzero(found < 0)
                found[k] = self._scan(self.least, block[k], below[todo[k]], step)
                block[k] += step * self.BLOCK
            edge = found * self.BLOCK if step > 0 else np.minimum(found * self.BLOCK + self.BLOCK, len(self.values)) - 1
            out[todo] = self._scan(self.values, edge, below[todo], step)
        return out


class FMIndex:
    """Compressed index over texts (arrays of symbols 1..size-1), each with a number; symbol 0 separates them.

    What stays: the transform's wavelet matrix, where each symbol's suffixes begin, common prefixes capped at one more than
    the depth, marks of the intervals of equal `depth` symbols, and the least number of the texts in each.  Texts, suffixes
    and ranks don't."""

    def __init__(self, texts: list[np.ndarray], size: int, depth: int, numbers: np.ndarray) -> None:
        self.depth = depth
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(lengths + 1) - lengths
        text = np.zeros(int((lengths + 1).sum()) + 1, np.int64)
        for t, b in zip(texts, begin, strict=True):
            text[b : b + len(t)] = t
        # one symbol more than the depth: backward search looks at strings of depth + 1
        suffixes, levels = sorted_suffixes(text, 1, depth + 1)
        self.n = n = len(text)
        self.first = np.searchsorted(text[suffixes], np.arange(size + 1))
        self.wavelet = WaveletMatrix(text[suffixes - 1], size)
        # neighbours share as many symbols as powers of two add up to; ranks beyond the text are unlike all others
        common, a, b = np.zeros(n + 1, np.int64), suffixes[:-1], suffixes[1:]
        for d, rank in reversed([x for x in levels if x[0] & (x[0] - 1) == 0]):
            i, j = a + common[1:n], b + common[1:n]
            inside = (i < n) & (j < n)
            common[1:n] += d * (inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)]))
        self.common = CommonPrefixes(np.minimum(common, depth + 1))
        edge = common[:n] < depth
        self.edges = BitVector(edge)
        owner = np.searchsorted(begin, suffixes, "right") - 1
        numbers = np.asarray(numbers, np.int64)
        self.least = np.minimum.reduceat(np.where(owner >= 0, numbers[np.maximum(owner, 0)], np.iinfo(np.int64).max), np.flatnonzero(edge))

    def _extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.first[c] + r[: len(c)], self.first[c] + r[len(c) :]

    def interval(self, place: np.ndarray) -> np.ndarray:
        """Number of the interval of equal `depth` symbols that a place in suffix order lies in."""
        return self.edges.rank1(place + 1) - 1

    def statistics(self, texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text and each of its places: how many of the next symbols the index holds as one string, at most
        `depth`, and a place in the suffix order where they stand.

        Backward search, all texts in lockstep.  Where a symbol can't be put before the match, the match gives up symbols at
        its end, as many as it takes for its interval to grow."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[k]) for k in order], np.int64)
        most = int(lengths.max(initial=0))
        grid = np.zeros((len(order), most), np.int64)
        for r, k in enumerate(order):
            grid[r, : len(texts[k])] = texts[k][::-1]
        matches, places = np.zeros(grid.shape, np.int16), np.zeros(grid.shape, np.int32)
        lo, hi, matched = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        for step in range(most):
            rows = int(np.searchsorted(-lengths, -step, "left"))  # texts longer than step
            todo = np.arange(rows)
            while len(todo):
                c = grid[todo, step]
                new_lo, new_hi = self._extend(c, lo[todo], hi[todo])
                ok = new_lo < new_hi
                r = todo[ok]
                lo[r], hi[r], matched[r] = new_lo[ok], new_hi[ok], matched[r] + 1
                todo = todo[~ok]
                todo = todo[matched[todo] > 0]  # a symbol the index doesn't have leaves the empty match
                if len(todo):
                    self._shrink(todo, lo, hi, matched, np.maximum(self.common.values[lo[todo]], self.common.values[hi[todo]]).astype(np.int64))
            over = np.flatnonzero(matched[:rows] > self.depth)
            if len(over):
                self._shrink(over, lo, hi, matched, np.full(len(over), self.depth))
            matches[:rows, step], places[:rows, step] = matched[:rows], lo[:rows]
        out: list = [None] * len(texts)
        for r, k in enumerate(order):
            n = len(texts[k])
            out[k] = matches[r, :n][::-1], places[r, :n][::-1]
        return out

    def _shrink(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, matched: np.ndarray, depth: np.ndarray) -> None:
        """Widen the rows' intervals to all suffixes that share the first `depth` symbols."""
        none = depth == 0
        lo[rows[none]], hi[rows[none]] = 0, self.n
        some, d = rows[~none], depth[~none]
        lo[some], hi[some] = self.common.nearest(lo[some], d, -1), self.common.nearest(hi[some], d, 1)
        matched[rows] = depth


def shard(contents: list[np.ndarray], docs: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """First doc of each window of each content (the place is not asked for).

    Contents are dealt by document to indexes of about PART words; each content is streamed through every index that holds
    its key, its own and those of other documents."""
    lengths = np.array([len(c) for c in contents], np.int64)
    words, symbols = np.unique(np.concatenate(contents), return_inverse=True)
    texts = np.split(symbols + 1, np.cumsum(lengths)[:-1])
    order = np.argsort(docs, kind="stable")
    total = np.cumsum(lengths[order])
    count = min(len(contents), max(2, -(-int(total[-1]) // PART)))
    part = np.empty(len(contents), np.int64)
    part[order] = np.minimum((total - 1) * count // total[-1], count - 1)
    found = [np.full(n - WINDOW + 1, np.iinfo(np.int64).max) for n in lengths]
    for p in range(count):
        own = np.flatnonzero(part == p)
        if not len(own):
            continue
        index = FMIndex([texts[k] for k in own], len(words) + 1, WINDOW, docs[own])
        asked = np.flatnonzero(np.isin(keys, keys[own]))
        for at in range(0, len(asked), STREAMED):
            some = asked[at : at + STREAMED]
            for k, (match, place) in zip(some, index.statistics([texts[k] for k in some]), strict=True):
                n = len(found[k])
                hit = np.flatnonzero(match[:n] >= WINDOW)
                found[k][hit] = np.minimum(found[k][hit], index.least[index.interval(place[hit].astype(np.int64))])
    return [(doc, np.zeros(len(doc), np.int64)) for doc in found]


def _output(ids: pa.Array, texts: list[str | None], unions: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    n, removed, hashes = [], [], []
    for text, (s, e) in zip(texts, unions, strict=True):
        words = (text or "").encode().split()
        n.append(len(words))
        removed.append(int((e - s).sum()))
        if len(s):
            kept, at = [], 0
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                kept += words[at:a]
                at = b
            words = kept + words[at:]
        hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def apply(docs: DataFrame) -> DataFrame:
    return repeated_windows(docs, "words", WINDOW, GRAM, shard, False, _output, "n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rn, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '') AS w FROM documents),
    win AS (SELECT rn, doc_id, at, md5(array_to_string(w[at:at + {WINDOW} - 1], ' ')) AS h FROM (SELECT rn, doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS at FROM d WHERE len(w) >= {WINDOW})),
    first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h HAVING count(*) > 1),
    gone AS (SELECT DISTINCT rn, p FROM (SELECT rn, unnest(range(at, at + {WINDOW})) AS p FROM win JOIN first USING (h) WHERE f < doc_id)),
    cut AS (SELECT rn, list(p) AS ps, count(*) AS k FROM gone GROUP BY rn)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_removed,
           sha256(array_to_string(CASE WHEN k IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN cut USING (rn)""".replace(" at,", " j,").replace("w[at:at", "w[j:j").replace("AS at", "AS j").replace("range(at, at", "range(j, j")


QUERIES = {"op9_fm_index": query}
ORACLES = {"op9_fm_index": _oracle()}
