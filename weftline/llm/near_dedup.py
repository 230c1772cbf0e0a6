"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document becomes its set of hashed shingles; equal sets are one class, whose representative has the least id.
2. Signatures of HASHES minima are cut into bands; classes that share a band are candidates.  A pair at the threshold
   0.75 shares no band with probability (1 - 0.75**ROWS)**BANDS, about 5e-6.
3. In each band's group every member is paired with the least one and with one drawn by hash (stars, never all pairs).  A pair's signatures are
   compared in batches of BATCH; once the posterior probability of similarity >= threshold (uniform prior) is below
   MISS, the pair is pruned.  Survivors are verified on their full sets.
4. Components of the verified links are found.  For members of groups that still hold several components, pairs across
   components are found by an exact prefix filter over the full sets: only pairs that share a rare shingle and can
   still reach the threshold are verified.  A pair inside a component can't change the result, so no link that matters
   is left out, and no group is capped.

Defined results: documents without words have an empty set, link with nothing and are kept; with fewer words than a
shingle, the whole sequence is the one shingle; a null doc_id never names a component while a number is in it, and its
rows are not kept unless the component has no number, when component_id is null and kept is false; repeated rows link, and
of rows that agree in doc_id and text one row is as good as another (ties); texts of any length give their whole set; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import CODES, LOWER, free_name, materialise, mix, prefix_sums, span_hash, table, text_batches, tidied, word_bounds

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
HASHES, BATCH, MISS = BANDS * ROWS, 16, 1e-7
#: Longest prefix whose shingles are carried into the exact round's join.
CARRIED = 256
#: Pairs of one document that are verified together, and rows of one shingle that are joined together.
HUB = 256
#: Ids of rows without doc_id start here.
NAMELESS = 1 << 62
#: Up to so many frequent shingles (16 octets each) are sent to all tasks to mark their rows; more than that are joined.
MARKED = 1 << 16

_RNG = np.random.default_rng(75)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    ws, we = word_bounds(data, offsets[1:-1])
    words = np.empty(0, np.uint64)
    if len(ws):
        words = span_hash(prefix_sums(CODES[LOWER[data]]), ws, we)
    sums = prefix_sums(words)
    limits = np.searchsorted(ws, offsets, "left")
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        n = b - a
        if n >= size:
            at = np.arange(a, b - size + 1)
            yield np.unique(span_hash(sums, at, at + size))
        else:
            yield span_hash(sums, np.array([a]), np.array([b])) if n else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(shingles), 2048):
        out = np.minimum(out, (_A[:, None] * shingles[None, k : k + 2048] + _B[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    one = prefix_sums(shingles)[-1]
    two = mix(shingles + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) ^ mix(np.array([len(shingles)], np.uint64))[0]
    return int(one.view(np.int64)), int(two.view(np.int64))


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For k = BATCH, 2 * BATCH, ...: the least number of equal minima at which P(similarity >= threshold) is not below miss."""
    out = []
    for k in range(BATCH, HASHES + 1, BATCH):
        # the posterior is Beta(m + 1, k - m + 1); its upper tail is a binomial sum
        tail = np.cumsum([comb(k + 1, j) * threshold**j * (1 - threshold) ** (k + 1 - j) for j in range(k + 1)])
        out.append(int(np.searchsorted(tail, miss)))
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows of two signature matrices that no batch prunes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, id, n, k1, k2, sig of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_batches(batch):
                n, k1, k2, sig = [], [], [], []
                for s in shingle_sets(data, offsets, size):
                    one, two = set_key(s)
                    n.append(len(s))
                    k1.append(one)
                    k2.append(two)
                    sig.append(signature(s).tobytes() if len(s) else None)
                count = len(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, count), batch.column(1).slice(row, count), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "id", "n", "k1", "k2", "sig"])

    return docs.select("doc_id", "id", "text").mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, id long, n long, k1 long, k2 long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(g, c): classes by band value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            g = np.full(sig.shape[:2], np.uint64(0)) + np.arange(BANDS, dtype=np.uint64)[None, :]
            for k in range(ROWS):
                g = mix(g ^ (sig[:, :, k] + np.uint64(0x9E3779B97F4A7C15)))
            yield pa.RecordBatch.from_arrays([pa.array(g.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["g", "c"])

    return classes.select("c", "sig").mapInArrow(tidied(run), "g long, c long")


def components(edges: DataFrame) -> DataFrame:
    """(c, comp): least node reachable, for every node of edges (a, b), by alternating large-star and small-star steps."""
    e = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        # large star: larger neighbours of a node move to the least of its neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node's smaller neighbours and itself move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = materialise(small.where("a <> b").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return e.select(F.col("a").alias("c"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("c"), F.col("b").alias("comp")).distinct())


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (g, c, comp) of groups that hold several components."""
    m = members.select("g", "c").join(labels, "c", "left").select("g", "c", F.coalesce("comp", "c").alias("comp"))
    mixed = m.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g")
    return materialise(m.join(mixed, "g"))


def _dealt(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """rows joined with the facts (sh, k, ...) of their shingle; a shingle of over HUB rows (k) is dealt in parts of about HUB."""
    hot = facts.where(F.col("k") > HUB).select("sh", F.ceil(F.col("k") / HUB).cast("int").alias("parts"))
    if hot.limit(MARKED + 1).count() > MARKED:  # many keys are large: hashed by shingle they even out, and Spark splits what doesn't
        return rows.join(facts, "sh", how)
    rows = rows.join(F.broadcast(hot), "sh", "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("c"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    last = F.when(F.col("k") > HUB, F.ceil(F.col("k") / HUB).cast("int") - 1).otherwise(0)
    return rows.join(facts.withColumn("part", F.explode(F.sequence(F.lit(0), last))), ["sh", "part"], how).drop("part")


def _prefix_pairs(members: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (c, comp) of different components that can reach the threshold, by an exact prefix filter.

    Shingles are ordered by how many members hold them.  Two sets at the threshold share one of the first n - ceil(p n) + 1
    of each; at any shared shingle, what can be shared before it (shingles only one member holds can't) and after it must
    add up to the least overlap.
    """
    need = members.join(classes.select("c", "k1", "k2"), "c")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_batches(batch, "text"):
                sets = list(shingle_sets(data, offsets, size))
                for k, s in enumerate(sets, row):
                    if set_key(s) == (batch.column(3)[k].as_py(), batch.column(4)[k].as_py()):
                        n = len(s)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[k].as_py())), pa.array(np.full(n, batch.column(1)[k].as_py())), pa.array(np.full(n, n)), pa.array(s.view(np.int64))], ["c", "comp", "n", "sh"])

    rows = docs.join(need, docs["id"] == need["c"]).select("c", "comp", "text", "k1", "k2").mapInArrow(tidied(unfold), "c long, comp long, n long, sh long")
    rows = materialise(rows.distinct())
    held = materialise(rows.groupBy("sh").agg(F.count("*").alias("k")).where("k > 1"))
    ranked = _dealt(rows, held, "left").select("c", "comp", "n", "sh", F.coalesce("k", F.lit(1)).alias("k"))
    order = Window.partitionBy("c").orderBy("k", "sh")
    ranked = ranked.withColumn("pos", F.row_number().over(order)).withColumn("shared", F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    prefix = materialise(ranked.where(f"k > 1 AND pos <= n - ({percent} * n + 99) DIV 100 + 1").drop("k"))
    # of each shingle in several components: its rows, those of the largest component, and into how many parts either side goes
    sides = prefix.groupBy("sh", "comp").agg(F.count("*").alias("k")).groupBy("sh").agg(F.sum("k").alias("k"), F.max(F.struct("k", "comp")).alias("x")).where("k > x.k")
    parts = lambda n: F.ceil(n / HUB).cast("int")
    sides = materialise(sides.select("sh", "k", F.col("x.comp").alias("largest"), parts(F.col("k")).alias("inner"), parts(F.col("k") - F.col("x.k")).alias("outer")))
    prefix = materialise(_dealt(prefix, sides, "inner").drop("k"))
    # with both prefixes at hand a pair is found once, at its first common shingle; longer prefixes are not carried along
    lists = prefix.groupBy("c").agg(F.count("*").alias("k"), F.sort_array(F.collect_list(F.struct("pos", "sh"))).alias("p")).where(F.col("k") <= CARRIED).select("c", F.col("p.sh").alias("p"))
    prefix = prefix.join(lists, "c", "left")
    # every pair of parts meets once: a row of one side goes to all parts of the other
    deal = lambda side: F.pmod(F.xxhash64("c"), F.col(side)).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    outside = prefix.where("comp <> largest").select("sh", deal("outer").alias("o"), every("inner").alias("i"), *[F.col(x).alias(f"{x}_1") for x in ("c", "comp", "n", "pos", "shared", "p")])
    inside = prefix.select("sh", every("outer").alias("o"), deal("inner").alias("i"), "c", "comp", "n", "pos", "shared", "p")
    least = f"({percent} * (n + n_1) + {percent} + 99) DIV {100 + percent}"
    bound = f"least(shared, shared_1) + least(n - pos, n_1 - pos_1) >= {least}"
    first = f"(p IS NULL OR p_1 IS NULL OR (1 + least(n - pos, n_1 - pos_1) >= {least} AND array_intersect(p, p_1)[0] = sh))"
    found = outside.join(inside, ["sh", "o", "i"]).where(f"comp <> comp_1 AND 100 * least(n, n_1) >= {percent} * greatest(n, n_1) AND {bound} AND {first}")
    return found.select(F.least("c", "c_1").alias("a"), F.greatest("c", "c_1").alias("b")).distinct()


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets reach the threshold."""
    least = least_matches(percent / 100)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3))
            keep = pa.array(survivors(x, y, least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    sigs = classes.select("c", "sig", "n")
    p = pairs.join(sigs.select(F.col("c").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a")
    p = p.join(sigs.select(F.col("c").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    # sizes alone can rule a pair out
    p = p.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    p = materialise(p.select("a", "b", "sa", "sb").mapInArrow(tidied(prune), "a long, b long"))

    needed = p.select(F.col("a").alias("c")).union(p.select(F.col("b").alias("c"))).distinct().join(classes.select("c", "k1", "k2"), "c")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_batches(batch, "text"):
                ids, blobs = [], []
                for k, s in enumerate(shingle_sets(data, offsets, size), row):
                    # of rows that share an id, the one the class stands for
                    if set_key(s) == (batch.column(2)[k].as_py(), batch.column(3)[k].as_py()):
                        ids.append(batch.column(0)[k].as_py())
                        blobs.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["c", "s"])

    full = docs.join(needed, docs["id"] == needed["c"]).select("c", "text", "k1", "k2").mapInArrow(tidied(sets), "c long, s binary")
    full = materialise(full.dropDuplicates(["c"]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (2, 3))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    # a hub has many pairs: they are dealt in parts of about HUB, each of which gets the hub's set once
    hubs = p.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
    q = p.join(hubs, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    q = q.join(full.select(F.col("c").alias("b"), F.col("s").alias("xb")), "b")
    sides = hubs.join(full.select(F.col("c").alias("a"), F.col("s").alias("xa")), "a").select("a", "xa", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    q = q.join(sides, ["a", "part"])
    return q.select("a", "b", "xa", "xb").mapInArrow(tidied(verify), "a long, b long")


def row_id():
    """doc_id, or a number from NAMELESS on that stands for the text where it is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("text"), 3))


def apply(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and class_id for every row."""
    component = F.when(F.col("comp") < NAMELESS, F.col("comp"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    return judged(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), F.col("c").alias("class_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of docs, all columns, of every component; rows without words all stay."""
    rows = materialise(judged(docs, size, percent).where(F.col("id") == F.col("comp")).select("id", "n"))
    again = rows.where("n > 0").groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    name = free_name(docs, "id")
    d = docs.select("*", row_id().alias(name))
    out = d.join(rows.select(F.col("id").alias(name)).distinct(), name, "left_semi")
    if again.limit(1).count():  # rows that repeat an id
        again = again.select(F.col("id").alias(name))
        out = out.join(again, name, "left_anti").unionByName(out.join(again, name, "left_semi").dropDuplicates([name]))
    return out.select(*docs.columns)


def judged(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, id, n (size of the set), comp (least id of the component) and c (the class) of every row."""
    d = docs.select("doc_id", row_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = materialise(_sketch(d, size))
    classes = materialise(sketch.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("c"), F.first("sig").alias("sig"), F.first("n").alias("n")))

    bands = _bands(classes)
    groups = bands.groupBy("g").agg(F.count("*").alias("k"), F.min("c").alias("x"), F.min(F.struct(F.xxhash64(F.lit(5), "c"), "c"))["c"].alias("y")).where("k > 1").select("g", "x", "y")
    members = materialise(bands.join(groups, "g"))
    star = members.select(F.explode(F.array("x", "y")).alias("h"), "c").where("c <> h").select(F.least("h", "c").alias("a"), F.greatest("h", "c").alias("b"))
    star = materialise(star.distinct())
    links = materialise(_verified(star, classes, d, size, percent))

    labels = components(links)
    m = _mixed(members, labels)
    # what is left, exactly: members of mixed groups that share a rare shingle across components
    left = materialise(m.select("c", "comp").distinct())
    if left.limit(1).count():
        across = materialise(_prefix_pairs(left, classes, d, size, percent).join(star, ["a", "b"], "left_anti"))
        if across.limit(1).count():
            links = links.unionByName(materialise(_verified(across, classes, d, size, percent)))
            labels = components(links)

    named = classes.select("k1", "k2", "c").join(labels, "c", "left").select("k1", "k2", "c", F.coalesce("comp", "c").alias("comp"))
    out = sketch.select("doc_id", "id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select("doc_id", "id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("comp")).alias("comp"), "c")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents")).drop("class_id")


def _oracle() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rn, doc_id, list_filter(string_split_regex({low}, '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT rn, doc_id, md5(array_to_string(w[j:j + {SHINGLE} - 1], ' ')) AS h FROM (SELECT rn, doc_id, w, unnest(range(1, greatest(1, len(w) - {SHINGLE} + 1) + 1)) AS j FROM d WHERE len(w) > 0)),
    n AS (SELECT rn, doc_id, count(*) AS n FROM s GROUP BY ALL),
    shared AS (SELECT a.rn AS x, b.rn AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.rn <> b.rn GROUP BY ALL),
    link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM shared JOIN n a ON a.rn = x JOIN n b ON b.rn = y WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
    comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
    FROM d LEFT JOIN n USING (rn) LEFT JOIN comp ON comp.x = d.doc_id"""


QUERIES = {"op3_near_dedup": query}
ORACLES = {"op3_near_dedup": _oracle()}
