"""CRC-32, Adler-32 and XXH64: per cell, combined, and folded over ordered chunks."""

from __future__ import annotations

import zlib
from decimal import Decimal

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import mapped

ADLER_MODULUS = 65521
CRC_POLYNOMIAL = 0xEDB88320


def crc32(octets: Column) -> Column:
    """Built in: stays inside code generation."""
    return F.crc32(octets)


def adler32(octets: Column) -> Column:
    return mapped(zlib.adler32, "bigint")(octets)


def xxh64(octets: Column, seed: int = 0) -> Column:
    """Unsigned XXH64 as DECIMAL(20,0). Seed 42 is a built-in expression, other seeds an Arrow function."""
    if seed == 42:
        h = F.xxhash64(octets).cast("decimal(20,0)")
        return F.when(octets.isNotNull(), F.when(h < 0, h + F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(h).cast("decimal(20,0)"))
    return mapped(lambda b: Decimal(xxhash.xxh64_intdigest(b, seed)), "decimal(20,0)")(octets)


def content_checksum(octets: Column) -> Column:
    """The low 32 bits of XXH64 with seed 0, as zstd frames carry them."""
    return mapped(lambda b: xxhash.xxh64_intdigest(b, 0) & 0xFFFFFFFF, "bigint")(octets)


def _multiply(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def crc32_combine(first: int, second: int, length: int) -> int:
    """CRC-32 of a concatenation from its parts' and the second part's length."""
    shift, power = 1 << 31, 1 << 30  # x**0 and x**1
    n = 8 * length
    while n:
        if n & 1:
            shift = _multiply(power, shift)
        power = _multiply(power, power)
        n >>= 1
    return _multiply(shift, first) ^ second


def adler32_combine(first: int, second: int, length: int) -> int:
    a1, s1, a2, s2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % ADLER_MODULUS
    return a | (s1 + s2 + length % ADLER_MODULUS * (a1 - 1)) % ADLER_MODULUS << 16


def fold(chunks: DataFrame, stream: str, order: str, octets: str, seed: int = 0, xxh: bool = True) -> DataFrame:
    """stream, length, crc32, adler32 and xxh64 of each stream's chunks in order.

    CRC and Adler are monoids: parts are summed where the chunks are, and only 24 octets a chunk are shuffled.  XXH64 is
    not; with xxh=True the chunks themselves meet by stream, streamed batch by batch in order, never gathered.
    """
    parts = chunks.select(F.col(stream).alias("stream"), F.col(order).alias("seq"), F.octet_length(F.col(octets)).cast("bigint").alias("n"), F.crc32(F.col(octets)).alias("crc"), adler32(F.col(octets)).alias("adler")).where("n IS NOT NULL")
    kind = dict(chunks.dtypes)[stream]

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        crc, adler, total = 0, 1, 0
        for n, c, a in zip(*(table[k].to_pylist() for k in ("n", "crc", "adler")), strict=True):
            crc, adler, total = crc32_combine(crc, c, n), adler32_combine(adler, a, n), total + n
        return pa.table({"stream": pa.array([key[0].as_py()], key[0].type), "length": [total], "crc32": [crc], "adler32": [adler]})

    sums = parts.groupBy("stream").applyInArrow(combine, f"stream {kind}, length long, crc32 long, adler32 long")
    if not xxh:
        return sums

    ordered = chunks.select(F.col(stream).alias("stream"), F.col(order).alias("seq"), F.col(octets).alias("octets")).where("octets IS NOT NULL").repartition("stream").sortWithinPartitions("stream", "seq")

    def digest(batches):
        now, state, type_ = None, None, None
        for b in batches:
            type_ = b.column(0).type
            for s, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if state is None or s != now:
                    if state is not None:
                        yield _digest_row(now, state, type_)
                    now, state = s, xxhash.xxh64(seed=seed)
                state.update(x)
        if state is not None:
            yield _digest_row(now, state, type_)

    folded = ordered.mapInArrow(digest, f"stream {kind}, xxh64 decimal(20,0)")
    return sums.join(folded, "stream", "left")


def _digest_row(stream, state, type_: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([stream], type_), pa.array([Decimal(state.intdigest())], pa.decimal128(20, 0))], ["stream", "xxh64"])
