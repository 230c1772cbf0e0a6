"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text are counted over its bytes in numpy.  The model is a sum of lookup tables over binned features:
boosting visits the features in turn, fits a small tree on the histogram of gradients and adds it, damped, to that
feature's table; then the pairs with the largest remaining gain get two-way tables in the same way.  Scoring adds up
table entries.

Labels come from rows whose crc32(doc_id) mod 3 is not 1.  At most about SAMPLE of them are used (chosen by a hash of
doc_id); features are counted for all documents.

Defined results: null and empty texts have all-zero features and get the model's score for those; without labels, or
with labels of one class, every score is that class's smoothed share; repeated rows are scored one by one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CODES, held_out, materialise, mix, prefix_sums, span_hash, table, text_batches, tidied, word_bounds

SAMPLE = 30_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 60, 30, 0.15

_CLASS = np.zeros(256, np.int64)
_CLASS[[0x20, 9, 11, 12, 13]] = 1
_CLASS[10] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
for _i, _c in enumerate(b"#*$%&|<>!?.,", 6):
    _CLASS[_c] = _i
_CLASS[128:192] = 18  # continuation bytes
_CLASS[192:] = 19
N_CLASSES = 20
FEATURES = (
    "words", "mean_length", "digits", "capitals", "hash", "star", "dollar", "percent", "ampersand", "bar", "angle", "mark", "question",
    "period", "comma", "other", "non_ascii", "distinct", "line_words", "distinct_lines", "top_word", "symbols",
)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of len(FEATURES) float32 for each text of a batch of UTF-8 bytes."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(doc * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(np.float64)
    ws, we = word_bounds(data, offsets[1:-1])
    owner = np.searchsorted(offsets, ws, "right") - 1
    words = np.bincount(owner, minlength=n).astype(np.float64)
    sums = prefix_sums(CODES[data])
    codes = span_hash(sums, ws, we)

    def repeated(own, code):
        """Distinct codes and the commonest one's count in each text."""
        order = np.argsort(mix(code ^ (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        o, c = own[order], code[order]
        first = np.ones(len(o), bool)
        first[1:] = (o[1:] != o[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(first)
        top = np.zeros(n)
        np.maximum.at(top, o[at], np.diff(np.append(at, len(o))))
        return np.bincount(o[at], minlength=n).astype(np.float64), top

    distinct, top = repeated(owner, codes) if len(codes) else (np.zeros(n), np.zeros(n))
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:]]))
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    lines = np.searchsorted(offsets, starts, "right") - 1
    n_lines = np.bincount(lines, minlength=n).astype(np.float64) if len(lines) else np.zeros(n)
    body = starts + (data[starts] == 10) if len(starts) else starts
    d_lines = repeated(lines, span_hash(sums, body, ends))[0] if len(lines) else np.zeros(n)
    w, size = np.maximum(words, 1), np.maximum(np.diff(offsets), 1)
    letters = np.maximum(count[:, 4] + count[:, 5] + count[:, 19], 1)
    symbols = count[:, 6:14].sum(axis=1)
    cols = [
        np.log1p(words), (size - count[:, 1] - count[:, 2] - count[:, 18]) / w, count[:, 3] / size, count[:, 4] / letters,
        *(count[:, k] / w for k in (6, 7, 8, 9, 10, 11)), (count[:, 12] + count[:, 13]) / w, *(count[:, k] / w for k in (14, 15, 16, 17)),
        count[:, 0] / size, count[:, 19] / size, distinct / w, words / np.maximum(n_lines, 1), d_lines / np.maximum(n_lines, 1), top / w, symbols / w,
    ]
    out = np.stack(cols, axis=1).astype(np.float32)
    out[words == 0] = 0
    return out


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for row, data, offsets in text_batches(b):
                f = features(data, offsets)
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(f)), *(pa.array(f[:, k]) for k in range(f.shape[1]))], ["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"`{x}` float" for x in FEATURES))


class Additive:
    """Lookup tables over binned features; see the module's text."""

    def __init__(self) -> None:
        self.base, self.edges, self.tables, self.pairs = 0.0, [], [], []

    @staticmethod
    def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
        """Best-first splits of a histogram; the step of each bin."""
        pieces, step = [(0, len(g))], np.zeros(len(g))
        value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
        while len(pieces) < leaves:
            best = (1e-6, None, None)
            for a, b in pieces:
                if b - a < 2:
                    continue
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gain = gl**2 / (hl + 1) + (g[a:b].sum() - gl) ** 2 / (h[a:b].sum() - hl + 1) - value(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (a, b), a + k + 1)
            if best[1] is None:
                break
            pieces.remove(best[1])
            pieces += [(best[1][0], best[2]), (best[2], best[1][1])]
        for a, b in pieces:
            step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
        return step

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            self.edges = [np.empty(0)] * (x.shape[1] if x.ndim == 2 else 0)
            self.tables = [np.zeros(1)] * len(self.edges)
            return self
        self.edges = [self._cuts(x[:, k], BINS) for k in range(x.shape[1])]
        b = self.binned(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for k, t in enumerate(self.tables):
                if len(t) < 2:
                    continue
                p = 1 / (1 + np.exp(-f))
                g, h = np.bincount(b[:, k], y - p, len(t)), np.bincount(b[:, k], p * (1 - p), len(t))
                step = RATE * self._tree(g, h)
                t += step
                f += step[b[:, k]]
        coarse = np.stack([np.searchsorted(self._cuts(b[:, k], PAIR_BINS), b[:, k], "right") for k in range(b.shape[1])], axis=1)
        maps = [np.searchsorted(self._cuts(b[:, k], PAIR_BINS), np.arange(len(t)), "right") for k, t in enumerate(self.tables)]
        p = 1 / (1 + np.exp(-f))
        gains = []
        for i in range(b.shape[1]):
            for j in range(i):
                at = coarse[:, i] * PAIR_BINS + coarse[:, j]
                g, h = np.bincount(at, y - p, PAIR_BINS**2), np.bincount(at, p * (1 - p), PAIR_BINS**2)
                gains.append((float((g**2 / (h + 1)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs.append((i, j, maps[i], maps[j], np.zeros((PAIR_BINS, PAIR_BINS))))
        for _ in range(PAIR_ROUNDS):
            for i, j, _, _, t in self.pairs:
                p = 1 / (1 + np.exp(-f))
                at = coarse[:, i] * PAIR_BINS + coarse[:, j]
                g = np.bincount(at, y - p, PAIR_BINS**2).reshape(t.shape)
                h = np.bincount(at, p * (1 - p), PAIR_BINS**2).reshape(t.shape)
                # a cross of one cut in each direction: four leaves
                best, cut = -1.0, (1, 1)
                cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
                for u in range(1, PAIR_BINS):
                    for v in range(1, PAIR_BINS):
                        total, quarter = 0.0, ((cg[u - 1, v - 1], ch[u - 1, v - 1]), (cg[-1, v - 1] - cg[u - 1, v - 1], ch[-1, v - 1] - ch[u - 1, v - 1]), (cg[u - 1, -1] - cg[u - 1, v - 1], ch[u - 1, -1] - ch[u - 1, v - 1]))
                        rest = (cg[-1, -1] - sum(q[0] for q in quarter), ch[-1, -1] - sum(q[1] for q in quarter))
                        total = sum(q[0] ** 2 / (q[1] + 1) for q in (*quarter, rest))
                        if total > best:
                            best, cut = total, (u, v)
                u, v = cut
                step = np.zeros_like(t)
                for rows in (slice(0, u), slice(u, None)):
                    for cols in (slice(0, v), slice(v, None)):
                        step[rows, cols] = RATE * g[rows, cols].sum() / (h[rows, cols].sum() + 1)
                t += step
                f += step.ravel()[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if not self.edges:
            return 1 / (1 + np.exp(-f))
        b = self.binned(x)
        for k, t in enumerate(self.tables):
            f += t[b[:, k]]
        for i, j, mi, mj, t in self.pairs:
            f += t[mi[b[:, i]], mj[b[:, j]]]
        return 1 / (1 + np.exp(-f))


def train(table_of_features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """labels: doc_id and y (0 or 1). At most about `sample` labelled rows, by a hash of doc_id, come to the driver."""
    labels = labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # sorted, as sums of floats depend on the order
    got = table_of_features.join(labels, "doc_id").select(F.xxhash64("doc_id").alias("h"), "y", *FEATURES).toArrow()
    got = got.sort_by([("h", "ascending"), *((x, "ascending") for x in FEATURES)])
    x = np.stack([got[k].to_numpy() for k in FEATURES], axis=1) if got.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    return Additive().fit(x, got["y"].to_numpy().astype(np.float64))


def apply(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """score and predicted for every row; labels: doc_id and y, already without the held-out rows."""
    feats = materialise(feature_table(docs))
    model = train(feats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(FEATURES))], axis=1) if b.num_rows else np.zeros((0, len(FEATURES)), np.float32)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return feats.mapInArrow(tidied(run), f"doc_id {dict(feats.dtypes)['doc_id']}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold. Features are counted as rows stream by."""
    labels = labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    # about `sample` ids: bounded, so they may be broadcast
    few = docs.select("doc_id", "text").join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi")
    model = train(feature_table(few), labels, sample * 2)
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, data, offsets in text_batches(b):
                good = model.score(features(data, offsets)) >= threshold
                yield b.slice(row, len(good)).filter(pa.array(good))

    return docs.select(*columns[:at], "text", *columns[at + 1 :]).mapInArrow(tidied(run), docs.schema)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out(3, 1)).select("doc_id", F.col("quality").alias("y"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality_gam": query}
ORACLES: dict[str, str] = {}
