"""Finding repeated windows: routing by content, shards, and results per document.

A document is a sequence of units (words or bytes).  Two equal windows of `width` units hold the same rarest-hash gram
(their anchor: the leftmost gram of `gram` units with the smallest hash), so windows are routed by their anchor and equal
windows always meet.  Consecutive windows of a document with one anchor form a segment.

1. `hot_keys`: anchors with very many different contexts (a frequent line) would fill one shard.  They are found in a
   sample of the texts.  Segments of a hot anchor are split: windows that reach far to the left of it are routed by the
   anchor with its left context, the others by the anchor with its right context; where that is hot too, each window is
   routed by itself.  Equal windows still meet, so the sample decides about balance only, never about results.
2. `_cut`: each task cuts its documents into segments.  Segments of equal content are collapsed inside the task before
   anything is shuffled: one goes to the bucket of its key, the others travel as plain occurrences to any bucket.
3. `_repeated`: a bucket keeps the segments whose key occurs twice or more together with the same left or right context
   (two equal windows share one of the two), and of each distinct content its first occurrence, the representative.
4. The representatives' units are read from their documents and go to the bucket's shards, where an index (FM-indexes or
   merged Burrows-Wheeler transforms) finds, for each window, the first document and place it starts in.
5. Occurrences are joined with their representative's windows; windows that start earlier elsewhere are removed.

Two segments are of equal content if 64 bits of their content's hash, 32 bits of their key and their bucket agree.

Row identity: doc_id orders documents; rows that share a doc_id are told apart by a 64-bit hash of their text.  A null doc_id
comes after all others.  Null texts are empty.  Very long texts are worked on in stretches of CHUNK units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CODES, materialise, mix, prefix_sums, sliding_argmin, span_hash, text_batches, tidied, word_bounds

#: One text (or stretch of STRETCH units of a long one) in so many is in the sample; contexts in it that make a key hot; and
#: the share of all sampled contexts it must hold, so that at most 1 / HOT_SHARE keys come to the driver.
SAMPLED, HOT, HOT_SHARE, STRETCH = 64, 16, 1e-6, 1 << 15
#: Units worked on at once, segments kept in a task before they are sent on, and octets of text taken at once.
CHUNK, FLUSH, PIECE = 1 << 19, 400_000, 1 << 20
FIELDS = (("m", "<u4"), ("ch", "<u8"), ("l", "<u2"), ("r", "<u2"), ("doc", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("n", "<u2"), ("multi", "u1"))
OCCURRENCE = "b int, m long, ch long, doc long, tag long, start long, n int, rep boolean"
NONE = np.empty(0, np.uint64)


def units_of(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the units of a batch of texts, and where each text's units begin and end."""
    if unit == "bytes":
        return CODES[data], offsets
    ws, we = word_bounds(data, offsets[1:-1])
    codes = np.empty(len(ws), np.uint64)
    at = 0
    while at < len(ws):  # hash sums over bounded stretches, so that one long text needs no arrays of its size times eight
        to = max(at + 1, int(np.searchsorted(we, ws[at] + 2 * CHUNK, "right")))
        lo, hi = ws[at], we[to - 1]
        codes[at:to] = span_hash(prefix_sums(CODES[data[lo:hi]]), ws[at:to] - lo, we[at:to] - lo)
        at = to
    return codes, np.searchsorted(ws, offsets, "left")


def _among(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(keys), bool)
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys


def segments(codes: np.ndarray, limits: np.ndarray, width: int, gram: int, hot: tuple[np.ndarray, np.ndarray] = (NONE, NONE), every: bool = False) -> dict[str, np.ndarray]:
    """start, n, key, ch (content hash) and l, r (hashes of left and right context, 0: none) of the segments of texts laid end to end.

    hot: sorted keys to split by side, and keys of sides to split into windows; every: split all by side."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("start", "n", "key", "ch", "l", "r")}
    for at in range(0, max(0, len(codes) - width + 1), CHUNK):
        part = codes[at : at + CHUNK + width - 1]
        windows = len(part) - width + 1
        sums = prefix_sums(part)
        first = np.arange(len(part) - gram + 1)
        grams = span_hash(sums, first, first + gram)
        anchor = sliding_argmin(grams, width - gram + 1)
        edges = limits[(limits > at) & (limits < at + len(part))] - at
        # windows that would cross the end of a text
        crossing = np.zeros(windows + 1, np.int32)
        np.add.at(crossing, np.clip(edges - width + 1, 0, windows), 1)
        np.add.at(crossing, np.clip(edges, 0, windows), -1)
        inside = np.cumsum(crossing[:-1]) == 0
        change = np.ones(windows, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        s = np.flatnonzero(change)
        last = np.append(s[1:], windows) - 1  # the last window of each
        s, last = s[inside[s]], last[inside[s]]
        g, size = anchor[s], np.full(len(s), gram)
        key = mix(grams[g])
        split = np.ones(len(s), bool) if every else _among(key, hot[0])
        if split.any():
            a = g[split]
            half = (width - gram) // 2
            ls, ll, rs, rl = s[split], np.minimum(last[split], a - half), np.maximum(s[split], a - half + 1), last[split]
            lk = mix(span_hash(sums, np.maximum(a - half, 0), a + gram) ^ np.uint64(0x1EF7))
            rk = mix(span_hash(sums, a, np.minimum(a + width - half, len(part))) ^ np.uint64(0x9167))
            ok, ko = ls <= ll, rs <= rl
            side = [np.concatenate([x[ok], y[ko]]) for x, y in ((ls, rs), (ll, rl), (a - half, a), (np.full(len(a), gram + half), np.full(len(a), width - half)), (lk, rk))]
            alone = _among(side[4], hot[1])
            if alone.any():
                n = (side[1] - side[0] + 1)[alone]
                w = np.repeat(side[0][alone] - np.cumsum(n) + n, n) + np.arange(n.sum())
                one = [w, w, w, np.full(len(w), width), mix(span_hash(sums, w, w + width) ^ np.uint64(0x0A1E))]
                side = [np.concatenate([x[~alone], y]) for x, y in zip(side, one, strict=True)]
            s, last, g, size, key = (np.concatenate([x[~split], y]) for x, y in zip((s, last, g, size, key), side, strict=True))
        # a window holds the gram with what stands `half` to the left of it, or with what stands as far to the right
        half = (width - size) // 2
        left = np.where(s <= g - half, (span_hash(sums, np.maximum(g - half, 0), g + size) >> np.uint64(48)) | np.uint64(1), 0)
        right = np.where(last > g - half, (span_hash(sums, g, np.minimum(g + width - half, len(part))) >> np.uint64(48)) | np.uint64(1), 0)
        for k, v in (("start", s + at), ("n", last - s + width), ("key", key), ("ch", span_hash(sums, s, last + width)), ("l", left), ("r", right)):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.empty(0, np.int64 if k in ("start", "n") else np.uint64) for k, v in out.items()}


def pack(cols: dict[str, np.ndarray]) -> bytes:
    return b"".join(cols[k].astype(t).tobytes() for k, t in FIELDS)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    size = sum(np.dtype(t).itemsize for _, t in FIELDS)
    n, at, out = len(blob) // size, 0, {}
    for k, t in FIELDS:
        out[k] = np.frombuffer(blob, t, n, at)
        at += n * np.dtype(t).itemsize
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted arrays."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(first)


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[at]


def hot_keys(d: DataFrame, unit: str, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of anchors, and of anchors with one side, that have very many different contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_batches(batch, most=PIECE):
                codes, limits = units_of(data, offsets, unit)
                parts = []
                for k in range(len(limits) - 1):
                    if offsets[k + 1] - offsets[k] <= STRETCH:
                        parts.append(codes[limits[k] : limits[k + 1]])
                        continue
                    at = np.arange(limits[k], limits[k + 1], STRETCH)  # stretches of a long text, drawn like texts
                    drawn_ = mix(np.uint64(tags[row + k] & 0xFFFFFFFF) + (at - limits[k]).astype(np.uint64)) % np.uint64(SAMPLED) == 0
                    parts += [codes[x : min(x + STRETCH, limits[k + 1])] for x in at[drawn_]]
                if not parts:
                    continue
                codes, limits = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                for level in (0, 1):
                    c = segments(codes, limits, width, gram, every=level > 0)
                    pairs = np.unique(np.stack([c["key"], c["ch"]], axis=1), axis=0).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), level, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["level", "key", "ch"])

    drawn = d.where((F.pmod("tag", F.lit(SAMPLED)) == 0) | (F.octet_length("text") > STRETCH)).select("tag", "text")
    counts = drawn.mapInArrow(tidied(run), "level int, key long, ch long").distinct().groupBy("level", "key").agg(F.count("*").alias("n"))
    counts = materialise(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    got = counts.where(F.col("n") >= max(HOT, int(HOT_SHARE * total))).select("level", "key").toArrow()
    level, key = got["level"].to_numpy(), got["key"].to_numpy().view(np.uint64)
    return np.sort(key[level == 0]), np.sort(key[level == 1])


def _cut(docs: DataFrame, unit: str, width: int, gram: int, buckets: int, hot) -> DataFrame:
    """(g, blob): one of each content of a task for its bucket g, further occurrences, with their buckets, for any group g < 0."""
    def send(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        held.clear()
        # by key and content; the order of places inside does not matter, _repeated sorts them
        order = np.argsort(c["key"])
        a = c["key"][order]
        twice = np.zeros(len(a), bool)
        twice[1:] = a[1:] == a[:-1]
        twice[:-1] |= a[1:] == a[:-1]
        some = np.flatnonzero(twice)  # only keys that occur again need their contents in order
        order[some] = order[some][np.lexsort((c["start"][order[some]], c["doc"][order[some]], c["ch"][order[some]], a[some]))]
        c = {k: v[order] for k, v in c.items()}
        at = _groups(c["key"], c["ch"])
        count = np.diff(np.append(at, len(order)))
        c["multi"] = np.zeros(len(order), np.uint8)
        c["multi"][at] = count > 1
        first = np.zeros(len(order), bool)
        first[at] = True
        c["b"], c["m"] = (c["key"] % np.uint64(buckets)).astype(np.int32), (c["key"] >> np.uint64(32)).astype(np.uint32)
        other = -1 - int(c["ch"][0] >> np.uint64(32)) % buckets
        rows: list[tuple[int, bytes]] = []
        d = {k: v[first] for k, v in c.items() if k != "key"}
        order = np.argsort(d["b"], kind="stable")
        d = {k: v[order] for k, v in d.items()}
        starts = _groups(d["b"])
        for s, e in zip(starts, [*starts[1:], len(order)], strict=True):
            rows.append((int(d["b"][s]), pack({k: d[k][s:e] for k, _ in FIELDS})))
        if not first.all():
            rows.append((other, c["b"][~first].tobytes() + pack({k: c[k][~first] for k, _ in FIELDS})))
        for k in range(0, len(rows), 4096):
            part = rows[k : k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], ["g", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_batches(batch, most=PIECE):
                codes, limits = units_of(data, offsets, unit)
                c = segments(codes, limits, width, gram, hot.value)
                if not len(c["start"]):
                    continue
                owner = np.searchsorted(limits, c["start"], "right") - 1
                held.append(c | {"doc": ids[row + owner], "tag": tags[row + owner], "start": c["start"] - limits[owner]})
                size += len(owner)
                if size >= FLUSH:
                    yield from send(held)
                    size = 0
        if held:
            yield from send(held)

    return docs.mapInArrow(tidied(run), "g int, blob binary")


def _repeated(key: tuple, group: pa.Table) -> pa.Table:
    """One group: occurrences of keys that occur twice or more with one context, representatives marked."""
    g, blobs = key[0].as_py(), [x.as_py() for x in group.column("blob")]
    if g < 0:  # buckets stand first
        size = 4 + sum(np.dtype(t).itemsize for _, t in FIELDS)
        cuts = [4 * (len(x) // size) for x in blobs]
        bs = np.concatenate([np.frombuffer(x, np.int32, k // 4) for x, k in zip(blobs, cuts, strict=True)])
        blobs = [x[k:] for x, k in zip(blobs, cuts, strict=True)]
    parts = [unpack(x) for x in blobs]
    c = {k: np.concatenate([p[k] for p in parts]) for k, _ in FIELDS}
    del parts, blobs
    c["b"] = bs if g < 0 else np.full(len(c["m"]), g, np.int32)
    rep = np.zeros(len(c["b"]), bool)
    if g >= 0:
        often = _times(c["m"]) > 1
        some = np.flatnonzero(often)
        keep = c["multi"] > 0
        for side in ("l", "r"):
            has = some[c[side][some] > 0]
            keep[has] |= _times((c["m"][has].astype(np.uint64) << np.uint64(16)) | c[side][has]) > 1
        c = {k: v[keep] for k, v in c.items()}
        order = np.lexsort((c["start"], c["doc"], c["ch"], c["m"]))
        c = {k: v[order] for k, v in c.items()}
        rep = np.zeros(len(order), bool)
        rep[_groups(c["m"], c["ch"])] = True
    return pa.table([
        pa.array(c["b"], pa.int32()), pa.array(c["m"].astype(np.int64)), pa.array(c["ch"].view(np.int64)), pa.array(c["doc"].astype(np.int64)), pa.array(c["tag"].astype(np.int64)),
        pa.array(c["start"].astype(np.int64)), pa.array(c["n"].astype(np.int32)), pa.array(rep),
    ], [x.split()[0] for x in OCCURRENCE.split(", ")])


def repeated_windows(docs: DataFrame, unit: str, width: int, gram: int, shard: Callable, with_place: bool, output: Callable, schema: str) -> DataFrame:
    """`output(ids, texts, spans)` for all rows of docs, spans being sorted arrays (start, end) of units that windows starting earlier cover.

    shard(contents, docs, starts, keys) gives for each content the first (doc, start) of each of its windows.  with_place: a
    window of the same document counts if it starts earlier; otherwise only smaller doc_ids count.
    """
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("tag", F.xxhash64("text"))
    buckets = max(16, 8 * d.rdd.getNumPartitions())
    hot = docs.sparkSession.sparkContext.broadcast(hot_keys(d, unit, width, gram))  # at most 1 / HOT_SHARE keys
    cut = _cut(d.select("doc", "text", "tag"), unit, width, gram, buckets, hot)
    near = materialise(cut.groupBy("g").applyInArrow(_repeated, OCCURRENCE))

    # units of the representatives, read from their documents; repeated rows are read once
    wanted = near.where("rep").groupBy("doc", "tag").agg(F.collect_list(F.struct("b", "m", "ch", "start", "n")).alias("w"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_batches(batch, "text", PIECE):
                codes, limits = units_of(data, offsets, unit)
                # the bytes themselves, or the words' 64-bit codes
                buffer, size = (data.tobytes(), 1) if unit == "bytes" else (codes.tobytes(), 8)
                lists = batch.column(2).slice(row, len(offsets) - 1)
                w = lists.flatten()
                b, m, ch, start, n = (w.field(k).to_numpy() for k in range(5))
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                at = (limits[owner] + start) * size
                blobs = [buffer[x:y] for x, y in zip(at.tolist(), (at + n * size).tolist(), strict=True)]
                doc = batch.column(0).to_numpy()[row + owner]
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(m), pa.array(ch), pa.array(doc), pa.array(start), pa.array(blobs, pa.binary())], ["b", "m", "ch", "doc", "start", "content"])

    contents = d.select("doc", "tag", "text").dropDuplicates(["doc", "tag"]).join(wanted, ["doc", "tag"]).select("doc", "text", "w")
    contents = contents.mapInArrow(tidied(read), "b int, m long, ch long, doc long, start long, content binary")

    def index(key: tuple, group: pa.Table) -> pa.Table:
        docs_, starts, ch, m = (group.column(k).to_numpy() for k in ("doc", "start", "ch", "m"))
        size = np.uint8 if unit == "bytes" else np.uint64
        found = shard([np.frombuffer(x.as_buffer(), size) for x in group.column("content")], docs_, starts, m)
        out = [[], [], [], [], [], []]
        for k, (doc, place) in enumerate(found):
            at = _groups(doc, place - np.arange(len(doc))) if with_place else _groups(doc)
            for x, v in zip(out, (np.full(len(at), m[k]), np.full(len(at), ch[k]), at, np.append(at[1:], len(doc)), doc[at], place[at]), strict=True):
                x.append(v)
        cols = [np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in out]
        return pa.table([pa.array(np.full(len(cols[0]), key[0].as_py()), pa.int32()), *map(pa.array, cols)], ["b", "m", "ch", "lo", "hi", "first", "place"])

    # written, so that the texts shuffled for the shards are gone before they are shuffled for the result
    runs = materialise(contents.groupBy("b").applyInArrow(index, "b int, m long, ch long, lo long, hi long, first long, place long"))
    occurrences = near.select("b", "m", "ch", "doc", "tag", "start")
    earlier = (F.col("first") < F.col("doc")) | ((F.col("first") == F.col("doc")) & (F.col("place") < F.col("start") + F.col("lo"))) if with_place else F.col("first") < F.col("doc")
    spans = occurrences.join(runs, ["b", "m", "ch"]).where(earlier)
    spans = spans.select("doc", "tag", (F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi") - 1 + width).alias("e"))
    # neighbouring spans of one segment are united here, all others by output()
    spans = materialise(spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("s", "e")).alias("spans")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                unions = []
                for x in batch.column(2).slice(at, 512):
                    if not x.is_valid or not len(x.values):
                        unions.append((np.empty(0, np.int64), np.empty(0, np.int64)))
                        continue
                    s, e = x.values.field(0).to_numpy(), x.values.field(1).to_numpy()
                    order = np.argsort(s)
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.ones(len(s), bool)
                    new[1:] = s[1:] > e[:-1]
                    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
                    unions.append((s[new], e[last]))
                yield output(batch.column(0).slice(at, 512), batch.column(1).slice(at, 512).to_pylist(), unions)

    out = d.select("doc_id", "doc", "tag", "text").join(spans, ["doc", "tag"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(tidied(finish), f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")
