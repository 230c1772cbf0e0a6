"""Row functions over Arrow arrays: one Python call a cell, one process boundary a batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import verdict

VERDICT = pa.struct([("value", pa.binary()), ("consumed", pa.int64()), ("error", pa.string()), ("error_class", pa.string())])
OPTIONS = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}


def octets(x) -> bytes:
    """The octets of a BINARY or STRING cell."""
    return x.encode("utf-8", "surrogatepass") if isinstance(x, str) else bytes(x)


def judged(f: Callable[[bytes], tuple[bytes, int]]) -> Callable[[Column], Column]:
    """A column function that gives the verdict of f, which returns (value, consumed) or raises Refused."""

    def batch(cells: pa.Array) -> pa.Array:
        out = []
        for x in cells.to_pylist():
            if x is None:
                out.append(None)
                continue
            try:
                value, consumed = f(octets(x))
                out.append({"value": value, "consumed": consumed, "error": None, "error_class": None})
            except verdict.Refused as e:
                out.append({"value": None, "consumed": e.offset, "error": e.error, "error_class": verdict.class_of(e.error)})
        return pa.array(out, VERDICT)

    return F.arrow_udf(batch, verdict.schema())


def mapped(f: Callable[[bytes], object], kind: str) -> Callable[[Column], Column]:
    """A column function of one value a cell."""
    arrow = OPTIONS.get(kind) or pa.decimal128(20, 0)

    def batch(cells: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(octets(x)) for x in cells.to_pylist()], arrow)

    return F.arrow_udf(batch, kind)
