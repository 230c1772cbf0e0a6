"""Encoders that take a stream in parts and flush: what was given so far can be decoded from the parts given out so far.

`encode_parts` keeps a native encoder for each stream while a task runs through its sorted chunks.  `encode_stream` is for
streaming DataFrames: native encoders can't be stored, but DEFLATE needs no more than the last 32 KiB as a dictionary, a
checksum and a length, so these are the state.  Zstandard and brotli have no such form and are refused there.

Null chunks are skipped; a stream of none gives an empty coded stream.  Rows of one stream with equal seq keep any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import codecs

WINDOW = 1 << 15


class Deflating:
    """gzip, zlib or deflate in parts, carried on from (length, check, window) at any flush."""

    def __init__(self, codec: str, level: int = 6, state: tuple[int, int, bytes] | None = None) -> None:
        self.codec, self.level = codec, level
        self.started = state is not None
        self.length, self.check, self.window = state or (0, 1 if codec == "zlib" else 0, b"")
        self._open(zdict=self.window) if self.window else self._open()

    def _open(self, **options) -> None:
        self.deflate = zlib.compressobj(self.level, wbits=-15, **options)

    def _head(self) -> bytes:
        if self.started:
            return b""
        self.started = True
        empty = codecs.ENCODERS[self.codec](b"", level=self.level)
        return empty[: {"gzip": 10, "zlib": 2, "deflate": 0}[self.codec]]

    def push(self, chunk: bytes, flush: bool = True) -> bytes:
        if self.codec != "deflate":
            self.check = zlib.crc32(chunk, self.check) if self.codec == "gzip" else zlib.adler32(chunk, self.check)
        self.length += len(chunk)
        self.window = (self.window + chunk[-WINDOW:])[-WINDOW:]
        return self._head() + self.deflate.compress(chunk) + (self.deflate.flush(zlib.Z_SYNC_FLUSH) if flush else b"")

    def finish(self) -> bytes:
        tail = {"gzip": struct.pack("<2I", self.check, self.length & 0xFFFFFFFF), "zlib": struct.pack(">I", self.check), "deflate": b""}
        return self._head() + self.deflate.flush() + tail[self.codec]

    @property
    def state(self) -> tuple[int, int, bytes]:
        """Only after a flush is nothing left in the native encoder."""
        return self.length, self.check, self.window


class _Zstd:
    def __init__(self, level: int = 3) -> None:
        self.frame = zstandard.ZstdCompressor(level=level).compressobj()

    def push(self, chunk: bytes, flush: bool = True) -> bytes:
        return self.frame.compress(chunk) + (self.frame.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK) if flush else b"")

    def finish(self) -> bytes:
        return self.frame.flush(zstandard.COMPRESSOBJ_FLUSH_FINISH)


class _Taken:
    """A sink that hands out what was written since the last time."""

    closed = False

    def __init__(self) -> None:
        self.parts: list[bytes] = []

    def write(self, b) -> int:
        self.parts.append(bytes(b))
        return len(self.parts[-1])

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.closed = True

    def take(self) -> bytes:
        out, self.parts = b"".join(self.parts), []
        return out


class _Brotli:
    """The library's own level: its streaming form takes none."""

    def __init__(self) -> None:
        self.sink = _Taken()
        self.stream = pa.CompressedOutputStream(pa.PythonFile(self.sink, "w"), "brotli")

    def push(self, chunk: bytes, flush: bool = True) -> bytes:
        self.stream.write(chunk)
        if flush:
            self.stream.flush()
        return self.sink.take()

    def finish(self) -> bytes:
        self.stream.close()
        return self.sink.take()


def encoder(codec: str, **options):
    """An object with push(chunk, flush) and finish(), each giving coded octets; options: level (not for brotli)."""
    return Deflating(codec, **options) if codec in ("gzip", "zlib", "deflate") else {"zstd": _Zstd, "brotli": _Brotli}[codec](**options)


def encode_parts(chunks: DataFrame, codec: str, flush: bool = True, **options) -> DataFrame:
    """stream, ordinal and part for rows (stream, seq, chunk): a part a chunk, then the part that ends the stream."""
    kind = dict(chunks.dtypes)["stream"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, coder, count = None, None, 0
        for b in batches:
            rows: list[tuple] = []
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if coder is None or s != now:
                    if coder is not None:
                        rows.append((now, count, coder.finish()))
                    now, coder, count = s, encoder(codec, **options), 0
                if x is not None:
                    rows.append((s, count, coder.push(bytes(x), flush)))
                    count += 1
            yield _rows(rows, b.column(0).type)
            type_ = b.column(0).type
        if coder is not None:
            yield _rows([(now, count, coder.finish())], type_)

    ordered = chunks.repartition("stream").sortWithinPartitions("stream", "seq").select("stream", "chunk")
    return ordered.mapInArrow(run, f"stream {kind}, ordinal int, part binary")


def _rows(rows: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
    stream, ordinal, part = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(stream, type_), pa.array(ordinal, pa.int32()), pa.array(part, pa.binary())], ["stream", "ordinal", "part"])


def encode_stream(chunks: DataFrame, codec: str, level: int = 6) -> DataFrame:
    """stream, ordinal and part for rows (stream, seq, chunk, last) of a streaming DataFrame, flushed after each micro-batch."""
    if codec not in ("gzip", "zlib", "deflate"):
        raise ValueError(f"the state of a {codec} encoder can't be stored")
    kind = dict(chunks.dtypes)["stream"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, check, window, count, done = state.get if state.exists else (0, 0, b"", 0, False)
        if done:
            return
        coder = Deflating(codec, level, (n, check, bytes(window)) if count else None)
        data = pd.concat(list(batches)).sort_values("seq")
        part = b"".join(coder.push(bytes(x), False) for x in data["chunk"] if x is not None)
        done = bool(data["last"].any())
        part += coder.finish() if done else coder.push(b"")
        state.update((*coder.state, count + 1, done))
        yield pd.DataFrame({"stream": [key[0]], "ordinal": [count], "part": [part]})

    kept = "n long, crc long, window binary, count int, done boolean"
    return chunks.groupBy("stream").applyInPandasWithState(run, f"stream {kind}, ordinal int, part binary", kept, "append", GroupStateTimeout.NoTimeout)
