"""Shared pieces: table loading, hot-key-safe materialisation, byte-level numpy kernels.

Row identity. ``doc_id`` may be null or repeated.  Operators that need a join read documents through
``keyed`` which adds ``rk``, a hash of (doc_id, text); rows that agree in both get the same result.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
_written: list[tuple[object, str]] = []
_own: dict[str, str] = {}
#: While a table is written: shuffle files go when their query ends, and Arrow batches of long texts stay small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a local session (tests), where all tasks share the machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="weftline-"))
    return named.rstrip("/")


def _forget() -> None:
    for spark, path in _written:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the folder's owner cleans it
            pass


atexit.register(_forget)


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors. by: a column with few values that
    get folders of their own.

    Shuffle files of the plan written are freed at its end, and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def forget(written: DataFrame, folder: str = "") -> None:
    """Delete what `materialise` wrote, or one folder of it, when nothing reads it any more."""
    spark, path = written.sparkSession, f"{written._weftline_path}/{folder}".rstrip("/")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidied(run):
    """`run` for mapInArrow, giving a worker's free memory back at the end of each task: workers live on, and their heaps
    and Arrow's pool would otherwise stay as large as they ever were."""

    def tidy_after(batches):
        yield from run(batches)
        _give_back()

    return tidy_after


def tidied_group(run):
    """The same for applyInArrow, after each group."""

    def tidy_after(key, group):
        out = run(key, group)
        del group
        _give_back()
        return out

    return tidy_after


def _give_back() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores after it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and rk, whatever other columns there are."""
    return docs.select("doc_id", "text", F.xxhash64(F.col("doc_id"), F.col("text")).alias("rk"))


def ascii_lower(text):
    """Lower-case A-Z only. lower() agrees on pure ASCII and is much faster there."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


# ---- numpy kernels over UTF-8 bytes ------------------------------------------------------------

R = np.uint64(0x9E3779B97F4A7C15 | 1)
RINV = np.uint64(pow(int(R), -1, 1 << 64))
#: Random odd-free byte codes from a fixed seed, so every worker agrees.
CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_pow_cache: dict[str, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = str(base)
    have = _pow_cache.get(key)
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        out = np.full(m, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        have = _pow_cache[key] = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """S with S[e]-S[s] = R**s * (polynomial hash of codes[s:e])."""
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * powers(R, len(codes)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, independent of their place."""
    return mix((sums[ends] - sums[starts]) * powers(RINV, len(sums))[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes other than white space; limits: offsets where texts begin."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~IS_SPACE[data]
    edge = inside[1:] != inside[:-1]
    starts, ends = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
    if limits is not None and len(limits) and len(starts):
        cut = limits[(limits > 0) & (limits < len(data))]
        cut = cut[inside[cut] & inside[cut + 1]]
        if len(cut):
            cut = np.unique(cut)
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each window of that width (block prefix/suffix minima)."""
    n = len(values)
    if n < width:
        return np.empty(0, np.int64)
    # the position in the low bits breaks ties towards the left; windows of equal content choose alike
    bits = np.uint64(max(1, int(n).bit_length()))
    key = ((values >> bits) << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[: n - width + 1], left[width - 1 : n])
    return (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def sorted_suffixes(key: np.ndarray, first: int, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes ordered by `depth` symbols, and (depth, ranks) after each doubling; equal ranks share that many symbols.

    key: a number for the first `first` symbols of each suffix, in their order.  Only groups that still tie are sorted on."""
    n = len(key)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(starts, sizes)
    levels = [(first, rank[:n].astype(np.int32))]
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while first < depth:
        step = min(first, depth - first)
        if len(tied):
            s = order[tied]
            k = (rank[s].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(s + step, n)] + 1).astype(np.uint64)
            o = np.argsort(k)
            s, k = s[o], k[o]
            order[tied] = s
            new = np.ones(len(s), bool)
            new[1:] = k[1:] != k[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(s)))
            rank[s] = np.repeat(tied[starts], sizes)
            tied = tied[np.repeat(sizes > 1, sizes)]
        first += step
        levels.append((first, rank[:n].astype(np.int32)))
    return order, levels


def text_batches(batch, column: str = "text", most: int = 1 << 20):
    """Slices of an Arrow batch as (first row, byte array, offsets), each of about `most` bytes or one text."""
    import pyarrow as pa

    arr = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        to = min(n, max(row + 1, to))
        yield row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
