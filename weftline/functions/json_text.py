"""Strict JSON (RFC 8259) and JSON text sequences (RFC 7464): tokens, verdicts, typed values, writing.

Spark's own JSON functions accept and rewrite things a strict reader must not: members of the same name, single quotes,
text after the value, lone surrogates, `1.50`.  Reading is therefore done here, one pass over the octets; writing uses
Spark's `to_json` with the options and repairs that make its text deterministic.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import octets
from .verdict import Refused, class_of

DEPTH_MOST, FRACTION_MOST = 1024, 19
SEPARATOR = 0x1E
NUMBER = r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?"

_SPACE = re.compile(rb"[ \t\n\r]*")
_PLAIN = re.compile(rb'[^"\\\x00-\x1f]*')
_DIGITS = re.compile(rb"[0-9]+")
_HEX = re.compile(rb"[0-9a-fA-F]{0,4}")
_ESCAPES = {0x22: b'"', 0x5C: b"\\", 0x2F: b"/", 0x62: b"\b", 0x66: b"\f", 0x6E: b"\n", 0x72: b"\r", 0x74: b"\t"}
_LITERALS = {0x74: b"true", 0x66: b"false", 0x6E: b"null"}


class _Reader:
    """One JSON text. followed: a record separator comes right after it."""

    def __init__(self, data: bytes, sequence: bool, followed: bool) -> None:
        self.data, self.at, self.sequence, self.followed = data, 0, sequence, followed

    def fail(self, error: str, at: int | None = None) -> None:
        raise Refused(error, self.at if at is None else at)

    def cut(self, followed: str = "IncompleteText") -> None:
        """The text ends where it must go on."""
        self.fail(followed if self.followed else "Truncated", len(self.data))

    def utf8(self, start: int, stop: int) -> None:
        part = self.data[start:stop]
        if part.isascii():
            return
        try:
            part.decode()
        except UnicodeDecodeError as e:
            if e.reason == "unexpected end of data" and stop == len(self.data):
                self.cut("InvalidUtf8")
            self.fail("InvalidUtf8", start + e.start)

    def unit(self) -> int:
        """Four hexadecimal digits."""
        m = _HEX.match(self.data, self.at)
        if len(m[0]) < 4:
            self.at = m.end()
            if self.at == len(self.data):
                self.cut("InvalidEscape")
            self.fail("InvalidEscape")
        self.at = m.end()
        return int(m[0], 16)

    def string(self) -> bytes:
        """After the quotation mark: the string's octets."""
        data, parts = self.data, []
        while True:
            m = _PLAIN.match(data, self.at)
            self.utf8(self.at, m.end())
            parts.append(m[0])
            self.at = m.end()
            if self.at == len(data):
                self.cut()
            c = data[self.at]
            if c == 0x22:
                self.at += 1
                return parts[0] if len(parts) == 1 else b"".join(parts)
            if c != 0x5C:
                self.fail("ControlCharacterInString")
            self.at += 1
            if self.at == len(data):
                self.cut("InvalidEscape")
            c = data[self.at]
            if c != 0x75:
                if c not in _ESCAPES:
                    self.fail("InvalidEscape")
                parts.append(_ESCAPES[c])
                self.at += 1
                continue
            self.at += 1
            u = self.unit()
            if 0xD800 <= u < 0xDC00:
                for want in b"\\u":
                    if self.at == len(data):
                        self.cut("LoneSurrogate")
                    if data[self.at] != want:
                        self.fail("LoneSurrogate")
                    self.at += 1
                low = self.unit()
                if not 0xDC00 <= low < 0xE000:
                    self.fail("LoneSurrogate", self.at - 1)
                u = 0x10000 + ((u - 0xD800) << 10) + low - 0xDC00
            elif 0xDC00 <= u < 0xE000:
                self.fail("LoneSurrogate", self.at - 1)
            parts.append(chr(u).encode())

    def digits(self) -> None:
        m = _DIGITS.match(self.data, self.at)
        if not m:
            if self.at == len(self.data):
                self.cut("InvalidNumber")
            self.fail("InvalidNumber")
        self.at = m.end()

    def number(self) -> bytes:
        data, start = self.data, self.at
        peek = lambda: data[self.at] if self.at < len(data) else -1
        if peek() == 0x2D:
            self.at += 1
        if peek() == 0x30:
            self.at += 1
            if 0x30 <= peek() <= 0x39:
                self.fail("InvalidNumber")
        else:
            self.digits()
        if peek() == 0x2E:
            self.at += 1
            self.digits()
        if peek() in (0x65, 0x45):
            self.at += 1
            if peek() in (0x2B, 0x2D):
                self.at += 1
            self.digits()
        return data[start : self.at]

    def literal(self, text: bytes) -> None:
        for want in text:
            if self.at == len(self.data):
                self.cut()
            if self.data[self.at] != want:
                self.fail("InvalidLiteral")
            self.at += 1

    def tokens(self) -> Iterator[tuple[str, int, bytes | None]]:
        data = self.data
        head = data[:3]
        if head == b"\xef\xbb\xbf":
            self.fail("ByteOrderMark", 0)
        if head[:1] == b"\xef":
            self.fail("ExpectedValue", 0)
        stack: list[bool] = []  # of open containers, whether it is an object
        expect, delimited = "value", True
        while True:
            before = self.at
            self.at = _SPACE.match(data, self.at).end()
            if expect == "end" and self.at > before:
                delimited = True
            if self.at == len(data):
                if expect != "end":
                    self.cut()
                if self.sequence and not delimited:
                    self.fail("UndelimitedValue")
                return
            c = data[self.at]
            if expect == "end":
                self.fail("TrailingOctets")
            if expect == "colon":
                if c != 0x3A:
                    self.fail("ExpectedNameSeparator")
                self.at += 1
                expect = "value"
                continue
            if expect == "next":
                if c == 0x2C:
                    self.at += 1
                    expect = "name" if stack[-1] else "value"
                    continue
                if c != (0x7D if stack[-1] else 0x5D):
                    self.fail("ExpectedValueSeparator")
            closes = expect == "next" or expect == "first" and c == (0x7D if stack[-1] else 0x5D)
            if closes:
                self.at += 1
                kind = "end_object" if stack.pop() else "end_array"
                yield kind, len(stack), None
            elif expect == "name" or expect == "first" and stack[-1]:
                if c != 0x22:
                    self.fail("ExpectedName")
                self.at += 1
                yield "name", len(stack), self.string()
                expect = "colon"
                continue
            elif c in (0x7B, 0x5B):
                if len(stack) == DEPTH_MOST:
                    self.fail("DepthTooLarge")
                self.at += 1
                yield "begin_object" if c == 0x7B else "begin_array", len(stack), None
                stack.append(c == 0x7B)
                expect = "first"
                continue
            elif c == 0x22:
                self.at += 1
                yield "string", len(stack), self.string()
            elif c in _LITERALS:
                self.literal(_LITERALS[c])
                yield _LITERALS[c].decode(), len(stack), None
                delimited = bool(stack)
            elif c == 0x2D or 0x30 <= c <= 0x39:
                yield "number", len(stack), self.number()
                delimited = bool(stack)
            else:
                self.fail("ExpectedValue")
            expect = "next" if stack else "end"


def tokens(data: bytes, sequence: bool = False, followed: bool = False) -> Iterator[tuple[str, int, bytes | None]]:
    """(kind, depth, octets) of each token; Refused at the first octet that breaks the text."""
    return _Reader(data, sequence, followed).tokens()


def check(data: bytes, sequence: bool = False, followed: bool = False) -> None:
    for _ in tokens(data, sequence, followed):
        pass


def sequence_texts(data: bytes) -> Iterator[tuple[int, int, str | None]]:
    """(start, stop, error) of the texts of a sequence; reading goes on at the next separator after a refused text."""
    cuts = [m.start() for m in re.finditer(b"\x1e", data)]
    if not cuts or cuts[0] > 0:
        if data:
            yield 0, cuts[0] if cuts else len(data), "MissingRecordSeparator"
        elif not cuts:
            yield 0, 0, "Truncated"
    if not cuts:
        return
    for start, stop in zip(cuts, [*cuts[1:], len(data)], strict=True):
        text, last = data[start + 1 : stop], stop == len(data)
        if not text and not last:
            continue
        try:
            check(text, True, not last)
            yield start + 1, stop, None
        except Refused as e:
            yield start + 1, stop, e.error


# ---- columns: verdicts -------------------------------------------------------------------------

CHECK = "struct<ok:boolean,error:string,error_class:string,offset:bigint>"
_CHECK = pa.struct([("ok", pa.bool_()), ("error", pa.string()), ("error_class", pa.string()), ("offset", pa.int64())])


def json_check(text: Column, sequence: bool = False) -> Column:
    """Whether each cell is one JSON text, and if not, the first error and where it is."""

    def batch(cells: pa.Array) -> pa.Array:
        out = []
        for x in cells.to_pylist():
            if x is None:
                out.append(None)
                continue
            try:
                data = octets(x)
                if sequence:
                    for _, stop, error in sequence_texts(data):
                        if error:
                            raise Refused(error, stop)
                else:
                    check(data)
                out.append({"ok": True, "error": None, "error_class": None, "offset": None})
            except Refused as e:
                out.append({"ok": False, "error": e.error, "error_class": class_of(e.error), "offset": e.offset})
        return pa.array(out, _CHECK)

    return F.arrow_udf(batch, CHECK)(text)


def is_json_number(text: Column) -> Column:
    """Built in."""
    return text.rlike(f"\\A{NUMBER}\\z")


def is_utf8(octets_: Column) -> Column:
    """Built in: whether octets are UTF-8 as RFC 3629 has it."""
    return F.is_valid_utf8(octets_.cast("string"))


# ---- columns: writing --------------------------------------------------------------------------

def quote(data: bytes) -> str:
    """A JSON string; escapes only what must be, in short form where there is one, else with lower-case digits."""
    try:
        return json.dumps(data.decode(), ensure_ascii=False)
    except UnicodeDecodeError:
        raise Refused("InvalidUtf8") from None


def from_tokens(items: list[tuple[str, bytes | None]]) -> str:
    """The compact text of a list of (kind, octets)."""
    out: list[str] = []
    stack: list[bool] = []
    expect = "value"
    for kind, data in items:
        closes = kind in ("end_object", "end_array")
        if closes:
            if not stack or stack[-1] != (kind == "end_object") or expect not in ("first", "next"):
                raise Refused("UnexpectedToken")
            stack.pop()
            out.append("}" if kind == "end_object" else "]")
            expect = "next" if stack else "end"
            continue
        named = kind == "name"
        if expect == "end" or named != (expect in ("first", "next") and bool(stack) and stack[-1]):
            raise Refused("UnexpectedToken")
        if expect == "next":
            out.append(",")
        if kind in ("begin_object", "begin_array"):
            if len(stack) == DEPTH_MOST:
                raise Refused("DepthTooLarge")
            stack.append(kind == "begin_object")
            out.append("{" if stack[-1] else "[")
            expect = "first"
            continue
        data = data or b""
        if named:
            out += [quote(data), ":"]
            expect = "value"
            continue
        if kind == "string":
            out.append(quote(data))
        elif kind == "hex":
            out.append(f'"{data.hex()}"')
        elif kind == "base64":
            out.append(f'"{base64.b64encode(data).decode()}"')
        elif kind in ("number", "unsigned", "signed", "decimal"):
            if not re.fullmatch(NUMBER, data.decode("latin-1")):
                raise Refused("InvalidNumber")
            out.append(data.decode())
        elif kind in ("true", "false", "null"):
            out.append(kind)
        else:
            raise Refused("UnexpectedToken")
        expect = "next" if stack else "end"
    if expect != "end":
        raise Refused("Truncated")
    return "".join(out)


TOKEN_ARRAY = "array<struct<pos:int,depth:int,kind:string,octets:binary>>"
_TOKEN_ARRAY = pa.list_(pa.struct([("pos", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("octets", pa.binary())]))


def json_tokens(text: Column) -> Column:
    """The tokens of each cell as an array, or null where it is refused; explode it, or use the `tokens` generator."""

    def batch(cells: pa.Array) -> pa.Array:
        out = []
        for x in cells.to_pylist():
            try:
                out.append(None if x is None else [{"pos": k, "depth": d, "kind": kind, "octets": v} for k, (kind, d, v) in enumerate(tokens(octets(x)))])
            except Refused:
                out.append(None)
        return pa.array(out, _TOKEN_ARRAY)

    return F.arrow_udf(batch, TOKEN_ARRAY)(text)


def try_json_from_tokens(items: Column) -> Column:
    """The text of each array of tokens (structs with kind and octets), as a verdict with a STRING value."""

    def batch(cells: pa.Array) -> pa.Array:
        out = []
        for x in cells.to_pylist():
            if x is None:
                out.append(None)
                continue
            try:
                s = from_tokens([(t["kind"], t["octets"]) for t in x])
                out.append({"value": s, "consumed": len(x), "error": None, "error_class": None})
            except Refused as e:
                out.append({"value": None, "consumed": None, "error": e.error, "error_class": class_of(e.error)})
        return pa.array(out, pa.struct([("value", pa.string()), ("consumed", pa.int64()), ("error", pa.string()), ("error_class", pa.string())]))

    return F.arrow_udf(batch, "struct<value:string,consumed:bigint,error:string,error_class:string>")(items)


#: Control characters whose escape Spark writes with capital letters.
_CAPITALS = [0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)]


def json_encode(value: Column) -> Column:
    """A struct, map or array as compact JSON: nulls are written, decimals keep their digits, escapes are lower case. Built in."""
    text = F.to_json(value, {"ignoreNullFields": "false"})
    fixed = text
    for c in _CAPITALS:
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u00{c:02X}", rf"$1\\u00{c:02x}")
    return F.when(text.rlike(r"\\u00[01][A-F]"), fixed).otherwise(text)


def hex_string(octets_: Column) -> Column:
    return F.lower(F.hex(octets_))


def decimal_text(negative: Column, integer: Column, fraction: Column, digits: Column) -> Column:
    """`[-]integer.fraction` with exactly `digits` digits of fraction. Built in."""
    return F.concat(F.when(negative, "-").otherwise(""), integer.cast("string"), F.lit("."), F.lpad(fraction.cast("string"), digits, F.lit("0")))


def sequence_record(text: Column) -> Column:
    """One text of a sequence: separator, text, line feed. Built in."""
    return F.concat(F.lit("\x1e"), text, F.lit("\n"))


# ---- columns: typed values ---------------------------------------------------------------------

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _whole(text: bytes, low: int, high: int) -> int:
    if not text.lstrip(b"-").isdigit():
        raise Refused("NumberOutOfRange")
    if len(text) > 21:
        raise Refused("NumberOutOfRange")
    n = int(text)
    if abs(n) >= 1 << 64 or not low <= n <= high:
        raise Refused("NumberOutOfRange")
    return n


def validate_shape(kind: T.DataType, depth: int = 0) -> None:
    """Refuse, when a query is built, types that no JSON text is read into."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            validate_shape(f.dataType, depth + 1)
    elif isinstance(kind, T.ArrayType):
        validate_shape(kind.elementType, depth + 1)
    elif not isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.StringType)):
        raise TypeError(f"{kind.simpleString()} has no strict JSON form")
    if depth > DEPTH_MOST:
        raise TypeError("the type is nested too deeply")


class _Binder:
    """Tokens to a value of a type. Field metadata: enum (names), default, length (of an array), unsigned (bits)."""

    def __init__(self, data: bytes) -> None:
        self.tokens = tokens(data)

    def read(self, kind: T.DataType, nullable: bool, meta: dict, token=None):
        name, _, data = token or next(self.tokens)
        if nullable and name == "null":
            return None
        if isinstance(kind, T.StructType):
            if name != "begin_object":
                raise Refused("TypeMismatch")
            return self.members(kind)
        if isinstance(kind, T.ArrayType):
            if name != "begin_array":
                raise Refused("TypeMismatch")
            return self.elements(kind, meta)
        if isinstance(kind, T.BooleanType):
            if name not in ("true", "false"):
                raise Refused("TypeMismatch")
            return name == "true"
        if isinstance(kind, T.StringType):
            if name != "string":
                raise Refused("TypeMismatch")
            text = data.decode()
            if "enum" in meta and text not in meta["enum"]:
                raise Refused("UnknownEnumName")
            return text
        if name != "number":
            raise Refused("TypeMismatch")
        if isinstance(kind, T.DecimalType) and kind.scale:
            text = data.decode()
            whole, _, fraction = text.lstrip("-").partition(".")
            if "e" in text.lower() or len(fraction) > FRACTION_MOST or int(whole) >= 1 << 64 or int(fraction or 0) >= 1 << 64:
                raise Refused("NumberOutOfRange")
            if len(fraction) > kind.scale or len(whole) > kind.precision - kind.scale:
                raise Refused("NumberOutOfRange")
            return Decimal(text)
        if isinstance(kind, T.DecimalType):
            n = _whole(data, -(10**kind.precision) + 1 if not meta.get("unsigned") else 0, min(10**kind.precision - 1, (1 << meta.get("unsigned", 64)) - 1))
            return Decimal(n)
        bits = _BITS[type(kind)]
        if "unsigned" in meta:
            return _whole(data, 0, (1 << meta["unsigned"]) - 1)
        return _whole(data, -(1 << (bits - 1)), (1 << (bits - 1)) - 1)

    def members(self, kind: T.StructType) -> dict:
        fields, out = {f.name: f for f in kind.fields}, {}
        while True:
            name, _, data = next(self.tokens)
            if name == "end_object":
                break
            key = data.decode()
            if key not in fields:
                raise Refused("UnknownField")
            if key in out:
                raise Refused("DuplicateField")
            f = fields[key]
            out[key] = self.read(f.dataType, f.nullable, f.metadata or {})
        for f in kind.fields:
            if f.name not in out:
                if "default" in (f.metadata or {}):
                    out[f.name] = f.metadata["default"]
                elif f.nullable:
                    out[f.name] = None
                else:
                    raise Refused("MissingField")
        return out

    def elements(self, kind: T.ArrayType, meta: dict) -> list:
        out, length = [], meta.get("length")
        while True:
            token = next(self.tokens)
            if token[0] == "end_array":
                if length is not None and len(out) != length:
                    raise Refused("ArrayLength")
                return out
            if len(out) == length:
                raise Refused("ArrayLength")
            out.append(self.read(kind.elementType, kind.containsNull, meta.get("element", {}), token))


def decode_value(data: bytes, kind: T.DataType, nullable: bool = False, meta: dict | None = None):
    """A text as a value of a type, or Refused."""
    binder = _Binder(data)
    out = binder.read(kind, nullable, meta or {})
    for _ in binder.tokens:  # what follows the value is judged too
        pass
    return out


def try_json_decode(text: Column, kind: T.DataType, nullable: bool = False, meta: dict | None = None) -> Column:
    """The verdict on each cell as a value of `kind`: no unknown, repeated or missing member, no coercion, no rounding."""
    from pyspark.sql.pandas.types import to_arrow_type

    validate_shape(kind)
    out_type = T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType()), T.StructField("error_class", T.StringType())])
    arrow = to_arrow_type(out_type)

    def batch(cells: pa.Array) -> pa.Array:
        out = []
        for x in cells.to_pylist():
            if x is None:
                out.append(None)
                continue
            try:
                out.append({"value": decode_value(octets(x), kind, nullable, meta), "error": None, "error_class": None})
            except Refused as e:
                out.append({"value": None, "error": e.error, "error_class": class_of(e.error)})
        return pa.array(out, arrow)

    return F.arrow_udf(batch, out_type)(text)


def json_decode(text: Column, kind: T.DataType, nullable: bool = False, meta: dict | None = None) -> Column:
    v = try_json_decode(text, kind, nullable, meta)
    return F.when(v["error"].isNotNull(), F.raise_error(F.concat(F.lit("refused: "), v["error"]))).otherwise(v["value"])
