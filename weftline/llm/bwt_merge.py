"""Suffix-array dedup by merging Burrows-Wheeler transforms.

A shard sorts the suffixes of its own texts once.  Two shards are merged without sorting again: the interleave starts
as all of the first before all of the second and is refined by eight symbols a round, each round a stable distribution of
the interleave by the symbols the transforms have before their suffixes.  The round in which two neighbours part gives
their common prefix, so the intervals that share a whole window, the repeated ones, are known at the end.

Query op10: texts are UTF-8 bytes, windows have 100 bytes.  Byte 0xFF, which UTF-8 never holds, ends a text inside a
shard.  Defined results: null and empty texts have no bytes; rows that share a doc_id are one document to each other
(the earlier start wins, equal starts remove nothing); a null doc_id comes after all others; very long texts are cut into
stretches, no byte is left out; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .anchors import repeated_windows
from .common import sorted_suffixes, table

WINDOW, GRAM = 100, 32
END = 0xFF
#: Bytes of one shard's own suffix sort.
PART = 1 << 19


def octads(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, in the order of bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


class Transform:
    """Texts joined with END, their suffixes in the order of `depth` symbols, and for each suffix the number of its interval:
    neighbours of one number share that many symbols."""

    def __init__(self, text: np.ndarray, suffixes: np.ndarray, intervals: np.ndarray) -> None:
        self.text, self.suffixes, self.intervals = text, suffixes, intervals

    @classmethod
    def of(cls, texts: list[np.ndarray], depth: int) -> Transform:
        text = np.full(sum(len(t) + 1 for t in texts), END, np.uint8)
        at = 0
        for t in texts:
            text[at : at + len(t)] = t
            at += len(t) + 1
        order, levels = sorted_suffixes(octads(text), 8, depth)
        return cls(text, order, levels[-1][1][order])


def interleave(a: Transform, b: Transform, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Which transform each suffix of the merged order comes from, and the interval of `symbols` common symbols it lies in.

    The interleave begins as all of a before all of b, one interval.  A round takes, in the order so far, the eight symbols
    that each transform has before its suffixes and deals the interleave out by them, stably: that orders it by eight
    symbols more.  Two neighbours part in the round in which their symbols differ, or what they were dealt from had parted;
    so common prefixes come from the rounds.  The first round uses what is left of `symbols` by eights."""
    n, size = len(a.suffixes), len(a.suffixes) + len(b.suffixes)
    z = np.zeros(size, bool)
    z[n:] = True
    interval = np.zeros(size, np.int64)
    before = []
    for t in (a, b):
        key = octads(np.concatenate([t.text, t.text[:8]]))[: len(t.text)]
        before.append(key[t.suffixes - 8])  # places before the first wrap around to the last text's end
    before = np.concatenate(before)
    place, low = np.arange(size), np.uint64(0xFFFFFFFF)
    distinct = None
    for width in ([symbols % 8] if symbols % 8 else []) + [8] * (symbols // 8):
        if width < 8 or distinct is None:
            keys = before & ((np.uint64(1) << np.uint64(8 * width)) - np.uint64(1)) if width < 8 else before
            distinct, code = np.unique(keys, return_inverse=True)
            code = code.astype(np.uint64)
            if width < 8:
                distinct = None
        ones = np.cumsum(z)
        mine = code[np.where(z, n - 1 + ones, place - ones)]
        dealt = np.sort((mine << np.uint64(32)) | place.astype(np.uint64))
        source = (dealt & low).astype(np.int64)
        parted = np.ones(size, bool)
        parted[1:] = ((dealt[1:] >> np.uint64(32)) != (dealt[:-1] >> np.uint64(32))) | (interval[source[1:]] != interval[source[:-1]])
        z, interval = z[source], np.cumsum(parted)
        if interval[-1] == size:
            break
    return z, interval


def merge(a: Transform, b: Transform, symbols: int) -> Transform:
    z, interval = interleave(a, b, symbols)
    suffixes = np.empty(len(z), np.int64)
    suffixes[~z], suffixes[z] = a.suffixes, b.suffixes + len(a.text)
    return Transform(np.concatenate([a.text, b.text]), suffixes, interval)


def subset(t: Transform, lengths: np.ndarray, keep: np.ndarray) -> Transform:
    """The transform of some of t's texts, by leaving the others out of its order."""
    octets = np.repeat(keep, lengths + 1)
    place = np.cumsum(octets) - 1
    left = octets[t.suffixes]
    return Transform(t.text[octets], place[t.suffixes[left]], t.intervals[left])


def merged(shards: list[Transform], symbols: int) -> Transform:
    """Pairwise, until one is left."""
    while len(shards) > 1:
        shards = [merge(shards[k], shards[k + 1], symbols) if k + 1 < len(shards) else shards[k] for k in range(0, len(shards), 2)]
    return shards[0]


def shard(contents: list[np.ndarray], docs: np.ndarray, starts: np.ndarray, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """First (doc, place) of each window of each content.

    Contents are dealt to shards by document, each with a transform of its own.  Windows with different keys can't be
    equal, so repeated intervals of texts whose key only one shard has are those of its own transform; what goes into the
    merge are the others."""
    lengths = np.array([len(c) for c in contents], np.int64)
    windows = lengths - WINDOW + 1
    first = np.cumsum(windows) - windows
    ids, rank = np.unique(docs, return_inverse=True)
    least = np.empty(int(windows.sum()), np.int64)

    order = np.argsort(docs, kind="stable")
    total = np.cumsum(lengths[order] + 1)
    count = min(len(contents), max(2, -(-int(total[-1]) // PART)))
    part = np.empty(len(contents), np.int64)
    part[order] = np.minimum((total - 1) * count // total[-1], count - 1)
    pairs = np.unique(np.stack([keys, part], axis=1), axis=0)
    several, times = np.unique(pairs[:, 0], return_counts=True)
    shared = np.isin(keys, several[times > 1])

    def collect(t: Transform, own: np.ndarray, wanted: np.ndarray) -> None:
        """Least (doc, place) of the windows of t's texts `own` (all in t's order) that are wanted."""
        size = lengths[own] + 1
        owner = np.repeat(np.arange(len(own)), size)
        inside = np.arange(len(t.text)) - np.repeat(np.cumsum(size) - size, size)
        asked = (wanted[owner] & (inside < windows[own][owner]))[t.suffixes]
        at, interval = t.suffixes[asked], t.intervals[asked]
        if not len(at):
            return
        k, inside = own[owner[at]], inside[at]
        value = (rank[k] << 40) | (starts[k] + inside)
        new = np.ones(len(at), bool)
        new[1:] = interval[1:] != interval[:-1]
        bounds = np.flatnonzero(new)
        least[first[k] + inside] = np.repeat(np.minimum.reduceat(value, bounds), np.diff(np.append(bounds, len(at))))

    subsets, owners = [], []
    for p in range(count):
        own = order[part[order] == p]
        if not len(own):
            continue
        t = Transform.of([contents[k] for k in own], WINDOW)
        collect(t, own, ~shared[own])
        if shared[own].any():
            subsets.append(subset(t, lengths[own], shared[own]))
            owners.append(own[shared[own]])
    if subsets:
        own = np.concatenate(owners)
        collect(merged(subsets, WINDOW), own, np.ones(len(own), bool))
    doc, place = ids[least >> 40], least & ((1 << 40) - 1)
    cuts = np.cumsum(windows)[:-1]
    return list(zip(np.split(doc, cuts), np.split(place, cuts), strict=True))


def _output(ids: pa.Array, texts: list[str | None], unions: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    n, removed, spans, hashes = [], [], [], []
    for text, (s, e) in zip(texts, unions, strict=True):
        raw = (text or "").encode()
        n.append(len(raw))
        removed.append(int((e - s).sum()))
        spans.append(len(s))
        h, at = hashlib.sha256(), 0
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            h.update(raw[at:a])
            at = b
        h.update(raw[at:])
        hashes.append(h.hexdigest())
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(hashes, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def apply(docs: DataFrame) -> DataFrame:
    return repeated_windows(docs, "bytes", WINDOW, GRAM, shard, True, _output, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bwt_merge": query}
ORACLES: dict[str, str] = {}
