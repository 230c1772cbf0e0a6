"""Table functions that take coded cells apart: gzip members, zstd frames, texts of a JSON sequence, JSON tokens.

Each is a lateral generator: `explode_with(df, members, F.col("coded"), ...)` keeps the row's other columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import codecs, json_text
from ..functions.arrow import octets
from ..functions.verdict import Refused, class_of

PARTS = "ordinal int, start bigint, stop bigint, value binary, error string, error_class string"
TOKENS = "pos int, depth int, kind string, octets binary, error string, error_class string"


def _parts(data: bytes, one: Callable) -> Iterator[tuple]:
    at, k = 0, 0
    while at < len(data) or not k:
        try:
            value, end = one(data, at)
        except Refused as e:
            yield k, at, None, None, e.error, class_of(e.error)
            return
        yield k, at, end, value, None, None
        at, k = end, k + 1


def members(data: bytes, max_output_len: int | None = None) -> Iterator[tuple]:
    """The members of a gzip file; the first refusal ends them with an error row."""
    return _parts(data, lambda d, at: codecs.gzip_member(d, at, max_output_len))


def frames(data: bytes, max_output_len: int | None = None, window_most: int = codecs.HTTP_WINDOW) -> Iterator[tuple]:
    """The frames of a Zstandard file; skippable frames give empty values."""
    return _parts(data, lambda d, at: codecs.zstd_frame(d, at, max_output_len, window_most))


def texts(data: bytes) -> Iterator[tuple]:
    """The texts of an RS-delimited JSON text sequence, each judged for itself."""
    for k, (start, stop, error) in enumerate(json_text.sequence_texts(data)):
        yield k, start, stop, data[start:stop] if error is None else None, error, class_of(error)


def tokens(data: bytes) -> Iterator[tuple]:
    """The tokens of a JSON text, and an error row where it is refused."""
    k = 0
    try:
        for kind, depth, value in json_text.tokens(data):
            yield k, depth, kind, value, None, None
            k += 1
    except Refused as e:
        yield k, 0, "error", None, e.error, class_of(e.error)


SCHEMAS = {members: PARTS, frames: PARTS, texts: PARTS, tokens: TOKENS}


def explode_with(df: DataFrame, generator: Callable, column: str, **options) -> DataFrame:
    """df's rows, one for each row the generator makes of `column`; null cells make none."""
    out = df.schema
    made = T.StructType.fromDDL(SCHEMAS[generator])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cols = [], [[] for _ in made.fields]
            for k, x in enumerate(b.column(at).to_pylist()):
                if x is None:
                    continue
                for values in generator(octets(x), **options):
                    row.append(k)
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                if len(row) >= 20_000:
                    yield batch(b, row, cols)
                    row, cols = [], [[] for _ in made.fields]
            yield batch(b, row, cols)

    arrow = {"IntegerType": pa.int32(), "LongType": pa.int64(), "StringType": pa.string(), "BinaryType": pa.binary()}
    types = [arrow[type(f.dataType).__name__] for f in made.fields]
    names = [*df.columns, *(f.name for f in made.fields)]

    def batch(b: pa.RecordBatch, row: list[int], cols: list[list]) -> pa.RecordBatch:
        keep = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([*(c.take(keep) for c in b.columns), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return df.mapInArrow(run, T.StructType([*out.fields, *made.fields]))
