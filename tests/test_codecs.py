"""Round trips, cuts, bit flips and streaming splits of the codecs; combined checksums."""

import random
import zlib

import pytest
import xxhash

from weftline.functions import base64, codecs
from weftline.functions.checksum import adler32_combine, crc32_combine
from weftline.functions.inflate_scan import scan
from weftline.functions.verdict import Refused
from weftline.streaming.chunks import decode_step

DATA = [b"", b"a", b"hello " * 50, bytes(range(256)) * 40, random.Random(1).randbytes(5000)]


@pytest.mark.parametrize("codec", sorted(codecs.ENCODERS))
def test_round_trip_and_cuts(codec):
    for data in DATA:
        coded = codecs.ENCODERS[codec](data)
        assert codecs.DECODERS[codec](coded) == (data, len(coded))
        for cut in range(1, min(len(coded), 12)):
            with pytest.raises(Refused) as found:
                codecs.DECODERS[codec](coded[:-cut])
            assert found.value.error in ("Truncated", "ChecksumMismatch")
        if len(data) > 10:
            with pytest.raises(Refused) as found:
                codecs.DECODERS[codec](coded, len(data) - 1)
            assert found.value.error == "NoSpaceLeft"
            assert codecs.DECODERS[codec](coded, len(data))[0] == data


@pytest.mark.parametrize("codec", ["gzip", "zlib", "zstd"])
def test_bit_flips_never_pass_checksums(codec):
    r, data = random.Random(2), b"abcdefgh" * 100
    coded = codecs.to_zstd(data, checksum=True) if codec == "zstd" else codecs.ENCODERS[codec](data)
    for _ in range(200):
        broken = bytearray(coded)
        broken[r.randrange(len(broken))] ^= 1 << r.randrange(8)
        try:
            out, _ = codecs.DECODERS[codec](bytes(broken))
        except Refused:
            continue
        assert out == data  # a header bit without meaning


@pytest.mark.parametrize("codec", sorted(codecs.ENCODERS))
def test_any_split_gives_the_same(codec):
    r = random.Random(3)
    many = codec in ("gzip", "zstd")
    data = [b"one " * 99, b"", b"three"] if many else [b"one " * 99]
    coded = b"".join(codecs.ENCODERS[codec](d) for d in data)
    for _ in range(30):
        cuts = sorted(r.randrange(len(coded) + 1) for _ in range(4))
        pending, got = b"", []
        for s, e in zip([0, *cuts], [*cuts, len(coded)], strict=True):
            values, pending, error = decode_step(pending + coded[s:e], codec, e == len(coded))
            assert error is None
            got += values
        assert b"".join(got) == b"".join(data) and pending == b""


def test_declared_window():
    far = bytes(1) + random.Random(4).randbytes(600)
    data = far + far
    coded = zlib.compress(data, 9)
    small = bytes([0x18, 31 - 0x1800 % 31]) + coded[2:]
    with pytest.raises(Refused) as found:
        codecs.zlib_octets(small)
    assert found.value.error == "DistanceTooFar"
    assert codecs.zlib_octets(coded)[0] == data


def test_scan_agrees_with_the_library():
    for data in DATA:
        for level in (0, 1, 6, 9):
            c = zlib.compressobj(level, wbits=-15)
            coded = c.compress(data) + c.flush()
            assert scan(coded + b"tail") == len(coded)


def test_combined_checksums():
    r = random.Random(5)
    for n in (0, 1, 7, 1000, 70000):
        a, b = r.randbytes(n // 3), r.randbytes(n)
        assert crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
        assert adler32_combine(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)


def test_check_values(spark):
    from pyspark.sql import functions as F

    from weftline.functions import checksum

    row = spark.createDataFrame([(b"123456789",)], "b binary").select(checksum.crc32(F.col("b")), checksum.adler32(F.col("b")), checksum.xxh64(F.col("b")), checksum.xxh64(F.col("b"), 42)).first()
    assert [int(x) for x in row] == [3421780262, 152961502, xxhash.xxh64_intdigest(b"123456789", 0), xxhash.xxh64_intdigest(b"123456789", 42)]


def test_base64_options():
    ok = [("Zh==", {"pad_bits": "drop"}, b"f"), ("Zm9=", {"pad_bits": "drop"}, b"fo"), ("-_", {"pad_bits": "drop"}, b"\xfb"), ("Zg==", {}, b"f"), ("Zg", {}, b"f"), ("", {}, b"")]
    for text, options, value in ok:
        assert base64.decode_octets(text.encode(), **options) == value
    bad = [
        ("ab-_", {"accept": "standard"}, "InvalidCharacter"), ("ab+/", {"accept": "url_safe"}, "InvalidCharacter"), ("Zg", {"padding": "required"}, "InvalidPadding"), ("Zg==", {"padding": "refused"}, "InvalidPadding"),
        ("Zm9vYmFy", {"max_output_len": 5}, "NoSpaceLeft"), ("Zm9vY", {"pad_bits": "drop"}, "InvalidLength"), ("Zh =", {"pad_bits": "drop"}, "InvalidCharacter"), ("Zh=", {"pad_bits": "drop"}, "InvalidPadding"),
    ]
    for text, options, error in bad:
        with pytest.raises(Refused) as found:
            base64.decode_octets(text.encode(), **options)
        assert found.value.error == error


def test_raising_form_fails_the_query(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(b"\x1f\x8b\x07",)], "b binary").select(codecs.decode(F.col("b"), "gzip"))
    with pytest.raises(Exception, match="refused: "):
        df.collect()
