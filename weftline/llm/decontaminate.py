"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

1. Every benchmark item gives windows of WINDOW consecutive words (one window if it is shorter).  Windows of equal
   words are one window with several owners.
2. A window's set is its SHINGLE-word shingles.  Containment of the whole set is asked for, so the prefix that must be
   joined is one shingle: the rarest in the corpus.  Counts come from all documents.
3. A document position whose shingle is a window's prefix is a candidate.  The shingle's place in the window fixes where
   the window would start (positional bound) and the document must be long enough (length bound).
4. Candidates are verified word for word on the document; the words of verified spans are hit.

What comes from the benchmark (shingles, prefixes with their words, owners) is broadcast only where its measured size is at
most BROADCAST octets; beyond that its join shuffles.

Defined results: null and empty texts have no words, no hits and are not contaminated; items without words have no
windows; texts and items of any length count whole; repeated rows are judged alike; of shingles that are equally rare
(ties) the one with the least hash is the prefix, which changes no result; null item_ids own no windows; empty tables give
no rows, or rows without hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, keyed, materialise, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 3
#: Octets of a table that is broadcast at most.
BROADCAST = 32 << 20


def words_of(text):
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """wid, words (array), owners (sorted item_ids as strings) of each distinct window."""
    w = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    w = w.where(F.size("words") > 0)
    n = F.size("words")
    w = w.select("item", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1))).alias("at"), "words")
    w = w.select("item", F.slice("words", F.col("at"), width).alias("words"))
    w = w.groupBy("words").agg(F.collect_set("item").alias("owners"))
    return w.select(F.xxhash64(F.array_join("words", " ")).alias("wid"), "words", "owners")


def _shingle(words: str, at: str, q: int) -> str:
    return "xxhash64(" + ", ".join(f"{words}[{at} + {i}]" for i in range(q)) + ")"


def shingles_of(windows: DataFrame, q: int) -> DataFrame:
    """wid, q, place (from 0) and sh of every shingle of every window; shorter windows are one shingle."""
    parts = [windows.where(F.size("words") == k).select("wid", F.lit(k).alias("q"), F.lit(0).alias("place"), F.expr(_shingle("words", "0", k)).alias("sh")) for k in range(1, q)]
    long = windows.where(F.size("words") >= q).select("wid", "words", F.explode(F.expr(f"sequence(0, size(words) - {q})")).alias("place"))
    out = long.select("wid", F.lit(q).alias("q"), "place", F.expr(_shingle("words", "place", q)).alias("sh"))
    for p in parts:
        out = out.unionByName(p)
    return out


def _positions(docs: DataFrame, q: int) -> DataFrame:
    """rk, n (words of the document), pos (from 0) and sh of the q-word shingles of documents."""
    d = docs.select("rk", words_of(F.col("text")).alias("words")).where(F.size("words") >= q)
    d = d.select("rk", "words", F.explode(F.expr(f"sequence(0, size(words) - {q})")).alias("pos"))
    return d.select("rk", F.expr("size(words)").alias("n"), "pos", F.expr(_shingle("words", "pos", q)).alias("sh"))


def covered(spans: str) -> str:
    """Words in the union of an array of (start, end) sorted by start."""
    return f"aggregate({spans}, struct(0L AS n, 0L AS last), (a, s) -> struct(a.n + greatest(0L, s.end - greatest(s.start, a.last)) AS n, greatest(a.last, s.end) AS last), a -> a.n)"


def apply(docs: DataFrame, items: DataFrame, width: int = WINDOW, q: int = SHINGLE) -> DataFrame:
    d = keyed(docs)
    windows = materialise(windows_of(items, width))
    shingles = materialise(shingles_of(windows, q))
    row = shingles.agg(F.countDistinct("q", "sh").alias("n"), F.sort_array(F.collect_set("q")).alias("sizes")).first()
    # octets, with what a row of a hashed relation takes besides
    listed = lambda c: F.coalesce(F.sum(F.octet_length(F.array_join(c, " ")) + 16 * F.size(c) + 96), F.lit(0))
    octets = windows.agg(listed("words").alias("words"), listed("owners").alias("owners")).first()

    def fit(df: DataFrame, size: int) -> DataFrame:
        return F.broadcast(df) if size <= BROADCAST else df

    found = None
    for k in row["sizes"]:
        wanted = shingles.where(F.col("q") == k).select("sh").distinct()
        part = _positions(d, k).join(fit(wanted, 64 * row["n"]), "sh").withColumn("q", F.lit(k))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = d.select("rk", F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("sh"), F.lit(0).alias("q")).where("false")
    found = materialise(found)

    counts = found.groupBy("q", "sh").agg(F.count("*").alias("df"))
    ranked = shingles.join(counts, ["q", "sh"], "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "sh", "place", "q")).alias("first"))
    prefixes = ranked.where("first.df > 0").select("wid", "first.sh", "first.place", "first.q").join(windows, "wid")
    prefixes = prefixes.select("wid", "sh", "q", "place", F.size("words").alias("len"), "words")
    hits = found.join(fit(prefixes, octets["words"]), ["q", "sh"])
    # positional and length bounds
    hits = hits.where("pos >= place AND pos - place + len <= n")
    # a window's words are carried once per document, however many candidates it has there
    cands = hits.groupBy("rk").agg(F.collect_set(F.struct((F.col("pos") - F.col("place")).cast("bigint").alias("start"), "wid")).alias("c"), F.map_from_entries(F.collect_set(F.struct("wid", "words"))).alias("w"))

    judged = d.select("doc_id", "rk", words_of(F.col("text")).alias("words")).join(cands, "rk", "left")
    judged = judged.select("doc_id", "rk", F.size("words").cast("long").alias("n_words"), "w", F.expr("filter(c, x -> slice(words, int(x.start) + 1, size(w[x.wid])) = w[x.wid])").alias("c"))
    judged = judged.select("doc_id", "rk", "n_words", F.expr("array_sort(transform(c, x -> struct(x.start AS start, x.start + size(w[x.wid]) AS end)))").alias("spans"), F.expr("array_distinct(transform(c, x -> x.wid))").alias("wids"))
    judged = judged.select("doc_id", "rk", "n_words", F.coalesce(F.expr(covered("spans")), F.lit(0)).cast("long").alias("n_hit"), "wids")
    judged = materialise(judged)

    owners = windows.select("wid", "owners")
    per_doc = judged.select("rk", F.explode("wids").alias("wid")).distinct().join(fit(owners, octets["owners"]), "wid")
    per_doc = per_doc.select("rk", F.explode("owners").alias("item")).groupBy("rk").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = judged.drop("wids").join(per_doc, "rk", "left")
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.expr("CASE WHEN items IS NULL THEN 0L ELSE bigint(size(items)) END").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "rk",
    )


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WINDOW, q: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    rk = free_name(docs, "rk")
    bad = apply(docs, items, width, q).where("contaminated").select(F.col("rk").alias(rk)).distinct()
    d = docs.select("*", F.xxhash64(F.col("doc_id"), F.col("text")).alias(rk))
    return d.join(bad, rk, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rk")


def _oracle() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(regexp_extract_all({low}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {words} AS w FROM documents),
    i AS (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
    win AS (SELECT DISTINCT item_id, array_to_string(w[j:j + {WINDOW} - 1], ' ') AS s, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS j FROM i WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM win),
    pos AS (SELECT rn, n, j, array_to_string(w[j:j + n - 1], ' ') AS s FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, sizes WHERE len(w) >= n)),
    hit AS (SELECT rn, j, pos.n AS n, item_id FROM pos JOIN win ON pos.s = win.s AND pos.n = win.n),
    cov AS (SELECT rn, count(DISTINCT p) AS k FROM (SELECT rn, unnest(range(j, j + n)) AS p FROM hit) GROUP BY rn),
    its AS (SELECT rn, count(*) AS k, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT rn, item_id::VARCHAR AS x FROM hit) GROUP BY rn)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.k, 0)::BIGINT AS n_hit, coalesce(its.k, 0)::BIGINT AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
           coalesce(cov.k, 0) > 0 AND 20 * coalesce(cov.k, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN cov USING (rn) LEFT JOIN its USING (rn)"""


QUERIES = {"op4_decontaminate": query}
ORACLES = {"op4_decontaminate": _oracle()}
