"""Coded streams that arrive in chunks: rows (stream, seq, chunk, last) of a streaming DataFrame.

State is kept by stream.  Checksums are integers and carry on exactly.  Native decoders can't be stored, so a decoder's
state is the coded part that no complete member or frame covers yet, at most `max_pending_len` octets; a member is given
out when its checks have passed, never before.  Any way of cutting a stream into chunks gives the same octets.

Chunks of one stream must arrive in order across micro-batches; inside one they are sorted by seq.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import codecs
from ..functions.verdict import Refused, class_of


def checksums(chunks: DataFrame) -> DataFrame:
    """stream, length, crc32 and adler32 after each micro-batch."""
    kind = dict(chunks.dtypes)["stream"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, crc, adler = state.get if state.exists else (0, 0, 1)
        for x in pd.concat(list(batches)).sort_values("seq")["chunk"]:
            if x is not None:
                n, crc, adler = n + len(x), zlib.crc32(x, crc), zlib.adler32(x, adler)
        state.update((n, crc, adler))
        yield pd.DataFrame({"stream": [key[0]], "length": [n], "crc32": [crc], "adler32": [adler]})

    return chunks.groupBy("stream").applyInPandasWithState(run, f"stream {kind}, length long, crc32 long, adler32 long", "n long, crc long, adler long", "update", GroupStateTimeout.NoTimeout)


def decode_step(pending: bytes, codec: str, last: bool, max_output_len: int | None = None, max_pending_len: int = 64 << 20) -> tuple[list[bytes], bytes, str | None]:
    """Values that are complete, the coded rest, and the error that ends the stream."""
    values: list[bytes] = []
    one = {"gzip": codecs.gzip_member, "zstd": codecs.zstd_frame}.get(codec)
    try:
        while pending:
            value, end = one(pending, 0, max_output_len) if one else codecs.DECODERS[codec](pending, max_output_len)
            values.append(value)
            pending = pending[end:]
            if not one and pending:
                return values, b"", "TrailingOctets"
    except Refused as e:
        if e.error != "Truncated" or last:
            return values, b"", e.error
        if len(pending) > max_pending_len:
            return values, b"", "NoSpaceLeft"
    return values, pending, None


def decode(chunks: DataFrame, codec: str, max_output_len: int | None = None, max_pending_len: int = 64 << 20) -> DataFrame:
    """stream, ordinal, value, status (member, done or refused), error and error_class."""
    kind = dict(chunks.dtypes)["stream"]
    out = f"stream {kind}, ordinal int, value binary, status string, error string, error_class string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, count, status = state.get if state.exists else (b"", 0, "open")
        rows = []
        data = pd.concat(list(batches)).sort_values("seq")
        if status == "open":
            pending = bytes(pending) + b"".join(bytes(x) for x in data["chunk"] if x is not None)
            last = bool(data["last"].any())
            values, pending, error = decode_step(pending, codec, last, max_output_len, max_pending_len)
            for v in values:
                rows.append((key[0], count, v, "member", None, None))
                count += 1
            if error:
                status = "refused"
                rows.append((key[0], count, None, status, error, class_of(error)))
            elif last:
                status = "done"
                rows.append((key[0], count, None, status, None, None))
        state.update((pending, count, status))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in out.split(", ")])

    return chunks.groupBy("stream").applyInPandasWithState(run, out, "pending binary, n int, status string", "append", GroupStateTimeout.NoTimeout)
