"""gzip, zlib, raw DEFLATE, Zstandard and brotli over BINARY columns.

Decoders are strict: every container check is made and named, members and frames are counted, nothing after them is
silently dropped, and ``max_output_len`` guards against bombs.  Names of errors inside Zstandard and brotli blocks are not
told apart by the native libraries: those are ``CorruptStream``.  Decoders of formats with one stream per text (zlib, raw
DEFLATE) return how much they took; gzip and Zstandard take all members or frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import judged, mapped
from .inflate_scan import scan
from .verdict import Refused, unwrap

HTTP_WINDOW = 8 << 20
ZSTD_MAGIC, SKIPPABLE = 0xFD2FB528, range(0x184D2A50, 0x184D2A60)
BLOCK_MOST = 128 << 10


# ---- decoding of one cell ----------------------------------------------------------------------

def _raw(data: bytes, most: int | None, window: int = 1 << 15) -> tuple[bytes, int]:
    """Octets of the DEFLATE stream at the start of data, and how long it is."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data, most + 1 if most is not None else 0)
    except zlib.error:
        scan(data, window)
        raise Refused("CorruptStream") from None
    if most is not None and len(out) > most:
        raise Refused("NoSpaceLeft")
    if not d.eof:
        if most is not None and d.unconsumed_tail:
            out += d.decompress(d.unconsumed_tail, 1)
            if len(out) > most:
                raise Refused("NoSpaceLeft")
        if not d.eof:
            scan(data, window)  # it may be refused before its end
            raise Refused("Truncated")
    if window < 1 << 15:
        scan(data, window)
    return out, len(data) - len(d.unused_data)


def inflate_octets(data: bytes, most: int | None = None) -> tuple[bytes, int]:
    return _raw(data, most)


def zlib_octets(data: bytes, most: int | None = None) -> tuple[bytes, int]:
    if len(data) < 2:
        raise Refused("Truncated")
    cmf, flags = data[0], data[1]
    if (cmf << 8 | flags) % 31:
        raise Refused("InvalidHeaderCheck", 0)
    if cmf & 15 != 8:
        raise Refused("InvalidMethod", 0)
    if cmf >> 4 > 7:
        raise Refused("InvalidWindowSize", 0)
    if flags & 32:
        raise Refused("PresetDictionary", 1)
    out, n = _raw(data[2:], most, 1 << ((cmf >> 4) + 8))
    trailer = data[2 + n : 6 + n]
    if len(trailer) < 4:
        raise Refused("Truncated")
    if int.from_bytes(trailer, "big") != zlib.adler32(out):
        raise Refused("ChecksumMismatch", 2 + n)
    return out, n + 6


def _gzip_header(data: bytes, at: int) -> int:
    """Where the member's DEFLATE stream begins."""
    start, head = at, data[at : at + 10]
    if len(head) < 10:
        raise Refused("Truncated")
    if head[:2] != b"\x1f\x8b":
        raise Refused("InvalidIdentification", at)
    if head[2] != 8:
        raise Refused("InvalidMethod", at + 2)
    flags = head[3]
    if flags & 0xE0:
        raise Refused("ReservedFlagSet", at + 3)
    at += 10
    if flags & 4:
        if at + 2 > len(data):
            raise Refused("Truncated")
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            at = data.find(b"\0", at) + 1
            if not at:
                raise Refused("Truncated")
    if flags & 2:
        if at + 2 > len(data):
            raise Refused("Truncated")
        if int.from_bytes(data[at : at + 2], "little") != zlib.crc32(data[start:at]) & 0xFFFF:
            raise Refused("HeaderChecksumMismatch", at)
        at += 2
    if at > len(data):
        raise Refused("Truncated")
    return at


def gzip_member(data: bytes, at: int = 0, most: int | None = None) -> tuple[bytes, int]:
    """One member's octets and where it ends."""
    at = _gzip_header(data, at)
    out, n = _raw(data[at:], most)
    at += n
    trailer = data[at : at + 8]
    if len(trailer) >= 4 and int.from_bytes(trailer[:4], "little") != zlib.crc32(out):
        raise Refused("ChecksumMismatch", at)
    if len(trailer) < 8:
        raise Refused("Truncated")
    if int.from_bytes(trailer[4:], "little") != len(out) & 0xFFFFFFFF:
        raise Refused("SizeMismatch", at + 4)
    return out, at + 8


def _all(data: bytes, one: Callable, most: int | None) -> tuple[bytes, int]:
    parts, at, room = [], 0, most
    while at < len(data) or not at:
        out, at = one(data, at, room)
        parts.append(out)
        room = room if room is None else room - len(out)
    return b"".join(parts), at


def gzip_octets(data: bytes, most: int | None = None) -> tuple[bytes, int]:
    return _all(data, gzip_member, most)


def _zstd_frame_end(data: bytes, at: int, window_most: int) -> tuple[int, int | None, bool]:
    """Where the frame at `at` ends, its content size if it says, and whether it is skippable."""
    head = data[at : at + 4]
    if len(head) < 4:
        whole = struct.pack("<I", ZSTD_MAGIC)
        skip = bool(head) and head[0] & 0xF0 == 0x50 and b"\x2a\x4d\x18".startswith(head[1:])
        raise Refused("Truncated" if whole.startswith(head) or skip else "InvalidMagic", at)
    magic = int.from_bytes(head, "little")
    if magic in SKIPPABLE:
        if at + 8 > len(data):
            raise Refused("Truncated")
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        if end > len(data):
            raise Refused("Truncated")
        return end, 0, True
    if magic != ZSTD_MAGIC:
        raise Refused("InvalidMagic", at)
    at += 4
    if at >= len(data):
        raise Refused("Truncated")
    d = data[at]
    single, ids, flag = bool(d & 32), (0, 1, 2, 4)[d & 3], d >> 6
    sizes = (1 if single else 0, 2, 4, 8)[flag]
    end = at + 1 + (not single) + ids + sizes
    if end > len(data):
        raise Refused("Truncated")
    if d & 8:
        raise Refused("ReservedBitSet", at)
    at += 1
    window = None
    if not single:
        base = 1 << (10 + (data[at] >> 3))
        window = base + (base >> 3) * (data[at] & 7)
        at += 1
    if int.from_bytes(data[at : at + ids], "little"):
        raise Refused("DictionaryUnsupported", at)
    at += ids
    content = int.from_bytes(data[at : at + sizes], "little") + (256 if sizes == 2 else 0) if sizes else None
    at += sizes
    window = content if window is None else window
    if window > window_most:
        raise Refused("WindowTooLarge")
    last = False
    while not last:
        if at + 3 > len(data):
            raise Refused("Truncated")
        h = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(h & 1), h >> 1 & 3, h >> 3
        if size > min(window, BLOCK_MOST):
            raise Refused("BlockTooLong", at)
        if kind == 3:
            raise Refused("ReservedBlockType", at)
        at += 3 + (1 if kind == 1 else size)
    at += 4 if d & 4 else 0
    if at > len(data):
        raise Refused("Truncated")
    return at, content, False


def zstd_frame(data: bytes, at: int = 0, most: int | None = None, window_most: int = HTTP_WINDOW) -> tuple[bytes, int]:
    """One frame's octets (none for a skippable frame) and where it ends."""
    end, content, skip = _zstd_frame_end(data, at, window_most)
    if skip:
        return b"", end
    if content is not None and most is not None and content > most:
        raise Refused("NoSpaceLeft")
    d = zstandard.ZstdDecompressor(max_window_size=max(1024, window_most)).decompressobj()
    parts, n = [], 0
    step = end - at if most is None else 4096
    try:
        for k in range(at, end, step):
            parts.append(d.decompress(data[k : min(end, k + step)]))
            n += len(parts[-1])
            if most is not None and n > most:
                raise Refused("NoSpaceLeft")
    except zstandard.ZstdError as e:
        raise Refused("ChecksumMismatch" if "checksum" in str(e) else "CorruptStream", at) from None
    if content is not None and n != content:
        raise Refused("ContentSizeMismatch", at)
    return b"".join(parts), end


def zstd_octets(data: bytes, most: int | None = None, window_most: int = HTTP_WINDOW) -> tuple[bytes, int]:
    return _all(data, lambda d, at, room: zstd_frame(d, at, room, window_most), most)


def _brotli_window(data: bytes, most_bits: int) -> None:
    """The window field at the start of a stream."""
    if not data:
        raise Refused("Truncated")
    bits = int.from_bytes(data[:2], "little")
    if not bits & 1:
        value = 16
    elif bits >> 1 & 7:
        value = 17 + (bits >> 1 & 7)
    elif bits >> 4 & 7 == 0:
        value = 17
    elif bits >> 4 & 7 == 1:
        raise Refused("InvalidWindowBits" if bits >> 7 & 1 else "LargeWindow", 0)
    else:
        value = 8 + (bits >> 4 & 7)
    if value > most_bits:
        raise Refused("WindowTooLarge", 0)


def _brotli_read(data: bytes, most: int | None) -> tuple[bytes, str]:
    """What the library reads from the start of data until it has over most octets, and what the error that ended it says.

    Streams that follow the first are read too.  Two things would hold memory for each refused cell: pyarrow's read() loses
    the bytes object it was to fill, readinto() doesn't; and an exception kept in a variable of a frame it came through is
    a cycle, with the streams' buffers in it, that waits for a full garbage collection.
    """
    out, buffer, error = bytearray(), memoryview(bytearray(1 << 16)), ""
    # A read that fails takes its output along, so the next pass comes back to it in shorter reads, the last octet by octet.
    for step in (1 << 16, 1 << 12, 1 << 8, 1 << 4, 1):
        part = buffer[:step]
        with pa.CompressedInputStream(pa.BufferReader(data), "brotli") as stream:
            done = len(out)
            while done:
                done -= stream.readinto(buffer[: min(done, len(buffer))])
            try:
                while n := stream.readinto(part):
                    out += part[:n]
                    if most is not None and len(out) > most:
                        break
                if not error:
                    break
            except OSError as e:
                error = str(e)
    return bytes(out), error


def _brotli_end(data: bytes, room: int) -> int | None:
    """Where the first stream ends, None if it doesn't; room bounds its output.

    One-shot decoding ignores what follows the stream, so it succeeds on every prefix that holds the stream and fails on
    the others: mostly one try, without the last octet, else a bisection.
    """
    codec = pa.Codec("brotli")

    def holds(n: int) -> bool:
        try:
            codec.decompress(pa.py_buffer(data)[:n], room)
        except OSError:
            return False
        return True

    if not holds(len(data) - 1):
        return len(data) if holds(len(data)) else None
    low, high = 0, len(data) - 1  # low doesn't hold it, high does
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def brotli_octets(data: bytes, most: int | None = None, window_bits_most: int = 24) -> tuple[bytes, int]:
    _brotli_window(data, window_bits_most)
    value, error = _brotli_read(data, most)
    full = most is not None and len(value) > most
    end = _brotli_end(data, most if full else len(value))
    if end is None and full:
        raise Refused("NoSpaceLeft")
    if end is None:
        raise Refused("Truncated" if "runcated" in error else "CorruptStream")
    return (value if end == len(data) else _brotli_read(data[:end], most)[0]), end


DECODERS: dict[str, Callable] = {"gzip": gzip_octets, "zlib": zlib_octets, "deflate": inflate_octets, "zstd": zstd_octets, "brotli": brotli_octets}


# ---- encoding of one cell ----------------------------------------------------------------------

def deflate_octets(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, wbits=-15)
    return c.compress(data) + c.flush()


def to_zlib(data: bytes, level: int = 6) -> bytes:
    return zlib.compress(data, level)


def to_gzip(data: bytes, level: int = 6) -> bytes:
    """A member whose header depends on the level only: no time, no name, unknown system."""
    extra = {1: 4, 9: 2}.get(level, 0)
    return struct.pack("<4BI2B", 0x1F, 0x8B, 8, 0, 0, extra, 255) + deflate_octets(data, level) + struct.pack("<2I", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def to_zstd(data: bytes, level: int = 3, checksum: bool = False, window_log: int | None = None) -> bytes:
    if window_log is None:
        c = zstandard.ZstdCompressor(level=level, write_checksum=checksum, write_content_size=True)
    else:
        parameters = zstandard.ZstdCompressionParameters.from_level(level, window_log=window_log, write_checksum=checksum, write_content_size=True)
        c = zstandard.ZstdCompressor(compression_params=parameters)
    return c.compress(data)


def to_brotli(data: bytes, level: int = 5) -> bytes:
    return pa.Codec("brotli", compression_level=level).compress(data, asbytes=True)


ENCODERS: dict[str, Callable] = {"gzip": to_gzip, "zlib": to_zlib, "deflate": deflate_octets, "zstd": to_zstd, "brotli": to_brotli}


# ---- columns -----------------------------------------------------------------------------------

def encode(octets: Column, codec: str, **options) -> Column:
    """octets in the named coding; options: level, and for zstd checksum and window_log."""
    f = ENCODERS[codec]
    return mapped(lambda b: f(b, **options), "binary")(octets)


def try_decode(coded: Column, codec: str, max_output_len: int | None = None, **options) -> Column:
    """The verdict on each cell; options: window_most (zstd), window_bits_most (brotli)."""
    f = DECODERS[codec]
    return judged(lambda b: f(b, max_output_len, **options))(coded)


def decode(coded: Column, codec: str, max_output_len: int | None = None, **options) -> Column:
    return unwrap(try_decode(coded, codec, max_output_len, **options))


def encoded_len_max(n: Column, codec: str) -> Column:
    """A bound on the coded length of n octets, by arithmetic."""
    n = n.cast("bigint")
    shift = lambda k: F.shiftright(n, k)
    deflate = n + F.shiftright(n + 7, 3) + F.shiftright(n + 63, 6) + 5
    return {
        "deflate": deflate, "zlib": deflate + 6, "gzip": deflate + 18,
        "zstd": n + shift(8) + F.when(n < BLOCK_MOST, F.shiftright(F.lit(BLOCK_MOST) - n, 11)).otherwise(0) + 22,
        "brotli": n + 6 + 4 * shift(14),
    }[codec].cast("bigint")


#: Cheap filters on the first octets; built in, so they can be evaluated before any decoding.
def has_magic(coded: Column, codec: str) -> Column:
    if codec == "gzip":
        return F.substring(coded, 1, 3) == F.lit(bytes([0x1F, 0x8B, 8]))
    if codec == "zstd":
        return F.substring(coded, 1, 4) == F.lit(struct.pack("<I", ZSTD_MAGIC))
    if codec == "zlib":
        word = F.conv(F.hex(F.substring(coded, 1, 2)), 16, 10).cast("int")
        return (word % 31 == 0) & (F.shiftright(word, 8).bitwiseAND(15) == 8)
    raise ValueError(f"{codec} has no magic octets")


def gzip_isize(coded: Column) -> Column:
    """The length a single member's trailer claims, unverified."""
    tail = F.hex(F.substring(coded, -4, 4))
    return F.conv(F.concat(*[F.substring(tail, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint")


def zstd_content_size(coded: Column) -> Column:
    """The length the first frame's header claims, or null; unverified."""
    def peek(b: bytes):
        try:
            n = zstandard.frame_content_size(b)
        except zstandard.ZstdError:
            return None
        return None if n < 0 else n

    return mapped(peek, "bigint")(coded)
