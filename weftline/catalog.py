"""Registered queries over the driver tables and their SQL equivalents, by the kind of function they exercise.

Every query reads whole tables.  Coded sizes depend on library versions, so queries show decoded octets, verdicts and
bounds, never coded bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import base64, checksum, codecs, json_text
from .functions.verdict import refusal
from .operators import splitters
from .plans import summaries

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
CODECS = ("gzip", "zlib", "deflate", "zstd", "brotli")


def _register(name: str, sql: str | None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _octets(text: str = "text") -> Column:
    return F.encode(F.col(text), "UTF-8")


# ---- the flagship ------------------------------------------------------------------------------

@_register("intact_by_source", "SELECT source, count(*) AS n_docs, sum(octet_length(encode(text)))::BIGINT AS octets, count(*) AS intact FROM documents GROUP BY source")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.intact_by(_table(spark, sf_dir, "documents"), "source", "text", "gzip", level=6)


# ---- codecs ------------------------------------------------------------------------------------

def _codec_queries(codec: str) -> None:
    @_register(f"{codec}_round_trip", "SELECT doc_id, text FROM documents")
    def round_trip(spark, sf_dir):
        d = _table(spark, sf_dir, "documents").select("doc_id", codecs.encode(_octets(), codec).alias("coded"))
        return d.select("doc_id", codecs.decode(F.col("coded"), codec).cast("string").alias("text"))

    @_register(f"{codec}_verdict", "SELECT page_id, octet_length(encode(html))::BIGINT AS octets, NULL::VARCHAR AS error, NULL::VARCHAR AS error_class, true AS all_taken FROM pages")
    def verdict(spark, sf_dir):
        d = _table(spark, sf_dir, "pages").select("page_id", codecs.encode(_octets("html"), codec).alias("coded"))
        d = d.withColumn("v", codecs.try_decode(F.col("coded"), codec))
        return d.select("page_id", F.octet_length("v.value").cast("bigint").alias("octets"), "v.error", "v.error_class", (F.col("v.consumed") == F.octet_length("coded")).alias("all_taken"))

    @_register(f"{codec}_truncated", "SELECT doc_id, 'Truncated' AS error, 'incomplete' AS error_class FROM documents")
    def truncated(spark, sf_dir):
        d = _table(spark, sf_dir, "documents").select("doc_id", codecs.encode(_octets(), codec).alias("coded"))
        d = d.select("doc_id", codecs.try_decode(F.expr("substring(coded, 1, octet_length(coded) - 1)"), codec).alias("v"))
        return d.select("doc_id", "v.error", "v.error_class")

    @_register(f"{codec}_no_space", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 500 THEN 'NoSpaceLeft' END AS error, CASE WHEN octet_length(encode(text)) > 500 THEN 'incomplete' END AS error_class FROM documents")
    def no_space(spark, sf_dir):
        d = _table(spark, sf_dir, "documents").select("doc_id", codecs.encode(_octets(), codec).alias("coded"))
        d = d.select("doc_id", codecs.try_decode(F.col("coded"), codec, max_output_len=500).alias("v"))
        return d.select("doc_id", "v.error", "v.error_class")

    @_register(f"{codec}_bound", "SELECT doc_id, true AS within FROM documents")
    def bound(spark, sf_dir):
        d = _table(spark, sf_dir, "documents").select("doc_id", _octets().alias("octets"))
        d = d.select("doc_id", F.octet_length("octets").alias("n"), F.octet_length(codecs.encode(F.col("octets"), codec)).alias("coded"))
        return d.select("doc_id", (F.col("coded") <= codecs.encoded_len_max(F.col("n"), codec)).alias("within"))


for _codec in CODECS:
    _codec_queries(_codec)


def _level_query(codec: str, level: int) -> None:
    @_register(f"{codec}_level_{level}", "SELECT item_id, text FROM benchmark")
    def at_level(spark, sf_dir):
        d = _table(spark, sf_dir, "benchmark").select("item_id", codecs.encode(_octets(), codec, level=level).alias("coded"))
        return d.select("item_id", codecs.decode(F.col("coded"), codec).cast("string").alias("text"))


for _codec, _levels in (("gzip", (1, 9)), ("zlib", (1, 9)), ("deflate", (1, 9)), ("zstd", (1, 3)), ("brotli", (1, 5))):
    for _level in _levels:
        _level_query(_codec, _level)


@_register("gzip_header", "SELECT doc_id, '1f8b080000000000' AS head, '00' AS flags, 'ff' AS system FROM documents")
def gzip_header(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", codecs.encode(_octets(), "gzip", level=6).alias("c"))
    h = lambda at, n: F.lower(F.hex(F.substring("c", at, n)))
    return d.select("doc_id", h(1, 8).alias("head"), h(9, 1).alias("flags"), h(10, 1).alias("system"))


@_register("gzip_isize", "SELECT doc_id, octet_length(encode(text))::BIGINT AS isize FROM documents")
def gzip_isize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", codecs.gzip_isize(codecs.encode(_octets(), "gzip")).alias("isize"))


@_register("zstd_content_size", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents")
def zstd_content_size(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", codecs.zstd_content_size(codecs.encode(_octets(), "zstd")).alias("n"))


def _many_query(codec: str) -> None:
    @_register(f"{codec}_many", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
    def many(spark, sf_dir):
        """One member or frame a turn, one file a conversation."""
        d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", codecs.encode(_octets(), codec).alias("coded"))
        d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "coded"))).alias("parts"))
        joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["coded"]))
        return d.select("conv_id", codecs.decode(joined, codec).cast("string").alias("text"))

    @_register(f"{codec}_split", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS ordinal, text FROM conversations")
    def split(spark, sf_dir):
        d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", codecs.encode(_octets(), codec).alias("coded"))
        d = d.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "coded"))).alias("parts"))
        d = d.select("conv_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["coded"])).alias("coded"))
        made = splitters.explode_with(d, splitters.members if codec == "gzip" else splitters.frames, "coded")
        return made.select("conv_id", "ordinal", F.col("value").cast("string").alias("text"))


_many_query("gzip")
_many_query("zstd")


@_register("gzip_checksum_refused", "SELECT doc_id, 'ChecksumMismatch' AS error, 'corrupt' AS error_class FROM documents")
def gzip_checksum(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", codecs.encode(_octets(), "gzip").alias("c"))
    d = d.withColumn("crc", F.expr("substring(c, octet_length(c) - 7, 4)"))
    flipped = F.unhex(F.translate(F.hex("crc"), "0123456789ABCDEF", "FEDCBA9876543210"))
    broken = F.concat(F.expr("substring(c, 1, octet_length(c) - 8)"), flipped, F.expr("substring(c, octet_length(c) - 3, 4)"))
    d = d.select("doc_id", codecs.try_decode(broken, "gzip").alias("v"))
    return d.select("doc_id", "v.error", refusal(F.col("v.error")).alias("error_class"))


@_register("gzip_size_refused", "SELECT doc_id, 'SizeMismatch' AS error FROM documents")
def gzip_size(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", codecs.encode(_octets(), "gzip").alias("c"))
    broken = F.concat(F.expr("substring(c, 1, octet_length(c) - 1)"), F.lit(b"\xee"))
    return d.select("doc_id", codecs.try_decode(broken, "gzip")["error"].alias("error"))


@_register("header_refusals", """SELECT * FROM (VALUES
    ('deflate', '07', 'InvalidBlockType', 'corrupt'), ('deflate', '0100000000', 'StoredLengthMismatch', 'corrupt'), ('deflate', 'fd0000', 'TooManyLiteralLengthCodes', 'corrupt'),
    ('gzip', '1f8a0800000000000003', 'InvalidIdentification', 'corrupt'), ('gzip', '1f8b0700000000000003', 'InvalidMethod', 'corrupt'), ('gzip', '1f8b0820000000000003', 'ReservedFlagSet', 'corrupt'),
    ('gzip', '1f8b08020000000000030000', 'HeaderChecksumMismatch', 'corrupt'), ('gzip', '1f8b', 'Truncated', 'incomplete'), ('zlib', '789d', 'InvalidHeaderCheck', 'corrupt'), ('zlib', '7918', 'InvalidMethod', 'corrupt'),
    ('zlib', '881c', 'InvalidWindowSize', 'corrupt'), ('zlib', '7820', 'PresetDictionary', 'unsupported'), ('zlib', '789c0300000000ff', 'ChecksumMismatch', 'corrupt'), ('zstd', '28b52ffe', 'InvalidMagic', 'corrupt'),
    ('zstd', '28b52ffd0069', 'WindowTooLarge', 'unsupported'), ('zstd', '28b52ffd010007', 'DictionaryUnsupported', 'unsupported'), ('zstd', '28b52ffd0800', 'ReservedBitSet', 'corrupt'), ('zstd', '28b52ffd0000070000', 'ReservedBlockType', 'corrupt'),
    ('zstd', '28b52ffd0000ffffff', 'BlockTooLong', 'corrupt'), ('brotli', '11', 'LargeWindow', 'unsupported'), ('brotli', '91', 'InvalidWindowBits', 'corrupt')) t(codec, coded, error, error_class)""")  # fmt: skip
def header_refusals(spark, sf_dir):
    cases = [  # fixed values: one input for each container-level refusal
        ("deflate", "07"), ("deflate", "0100000000"), ("deflate", "fd0000"), ("gzip", "1f8a0800000000000003"), ("gzip", "1f8b0700000000000003"), ("gzip", "1f8b0820000000000003"), ("gzip", "1f8b08020000000000030000"),
        ("gzip", "1f8b"), ("zlib", "789d"), ("zlib", "7918"), ("zlib", "881c"), ("zlib", "7820"), ("zlib", "789c0300000000ff"), ("zstd", "28b52ffe"), ("zstd", "28b52ffd0069"),
        ("zstd", "28b52ffd010007"), ("zstd", "28b52ffd0800"), ("zstd", "28b52ffd0000070000"), ("zstd", "28b52ffd0000ffffff"), ("brotli", "11"), ("brotli", "91"),
    ]
    d = spark.createDataFrame(cases, "codec string, coded string")
    v = None
    for codec in CODECS:
        part = d.where(F.col("codec") == codec).select("codec", "coded", codecs.try_decode(F.unhex("coded"), codec).alias("v"))
        v = part if v is None else v.unionByName(part)
    return v.select("codec", "coded", "v.error", "v.error_class")


@_register("magic_first", "SELECT doc_id, octet_length(encode(text))::BIGINT AS octets FROM documents")
def magic_first(spark, sf_dir):
    """Texts of an even number of octets are gzip, the others plain: the built-in filter keeps the decoder from these."""
    d = _table(spark, sf_dir, "documents").withColumn("o", _octets())
    d = d.select("doc_id", F.when(F.octet_length("o") % 2 == 0, codecs.encode(F.col("o"), "gzip")).otherwise(F.col("o")).alias("cell"))
    coded = summaries.decode_where_marked(d, "cell", "gzip").select("doc_id", F.octet_length("v.value").cast("bigint").alias("octets"))
    plain = d.where(~F.coalesce(codecs.has_magic(F.col("cell"), "gzip"), F.lit(False)))
    return coded.unionByName(plain.select("doc_id", F.octet_length("cell").cast("bigint").alias("octets")))


@_register("brotli_trailing", "SELECT item_id, text, true AS exact, kind = 'alone' AS whole, kind FROM benchmark, (VALUES ('alone'), ('two'), ('tail')) AS k(kind)")
def brotli_trailing(spark, sf_dir):
    """A stream alone, before another stream and before other octets: its own value, and its own end, come back."""
    d = _table(spark, sf_dir, "benchmark").select("item_id", codecs.encode(_octets(), "brotli").alias("c"))
    cells = {"alone": F.col("c"), "two": F.concat("c", "c"), "tail": F.concat("c", F.lit(b"\x00\xff\x00"))}
    d = d.select("item_id", "c", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("cell")) for k, x in cells.items()])).alias("k"))
    d = d.select("item_id", "c", "k.kind", F.col("k.cell").alias("cell")).withColumn("v", codecs.try_decode(F.col("cell"), "brotli"))
    end = F.col("v.consumed")
    return d.select("item_id", F.col("v.value").cast("string").alias("text"), (end == F.octet_length("c")).alias("exact"), (end == F.octet_length("cell")).alias("whole"), "kind")


@_register("zstd_options", "SELECT item_id, text, true AS checked FROM benchmark")
def zstd_options(spark, sf_dir):
    d = _table(spark, sf_dir, "benchmark").select("item_id", _octets().alias("o"))
    d = d.withColumn("c", codecs.encode(F.col("o"), "zstd", level=3, checksum=True, window_log=17))
    value = F.conv(F.concat(*[F.substring(F.hex(F.expr("substring(c, octet_length(c) - 3, 4)")), k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    return d.select("item_id", codecs.decode(F.col("c"), "zstd").cast("string").alias("text"), (value == checksum.content_checksum(F.col("o"))).alias("checked"))


# ---- checksums ---------------------------------------------------------------------------------

_CRC = """(SELECT xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
    list_reduce(list_prepend(xor(c, x), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))))"""


@_register("crc32", f"""WITH o AS (SELECT c_custkey, list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::BIGINT) AS b FROM customer)
    SELECT c_custkey, {_CRC}::BIGINT AS crc FROM o""")
def crc32(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", checksum.crc32(_octets("c_name")).alias("crc"))


@_register("adler32", """WITH o AS (SELECT p_partkey, list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i])::BIGINT) AS b, length(p_name) AS n FROM part),
    s AS (SELECT p_partkey, (1 + list_sum(b)) % 65521 AS a, (n + list_sum(list_transform(range(1, n + 1), lambda i: (n - i + 1) * b[i]))) % 65521 AS s FROM o)
    SELECT p_partkey, (s * 65536 + a)::BIGINT AS adler FROM s""")
def adler32(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", checksum.adler32(_octets("p_name")).alias("adler"))


@_register("xxh64", None)
def xxh64(spark, sf_dir):
    """Seeds 0 and 42, and the frame checksum; 42 is Spark's own hash."""
    d = _table(spark, sf_dir, "documents").select("doc_id", _octets().alias("o"))
    return d.select("doc_id", checksum.xxh64(F.col("o")).alias("seed_0"), checksum.xxh64(F.col("o"), 42).alias("seed_42"), checksum.content_checksum(F.col("o")).alias("low"))


_ASCII_FOLD = """WITH o AS (SELECT c_nationkey, string_agg(c_name, '' ORDER BY c_custkey) AS t FROM customer GROUP BY c_nationkey),
    b AS (SELECT c_nationkey, length(t) AS n, list_transform(range(1, length(t) + 1), lambda i: ascii(t[i])::BIGINT) AS b FROM o)"""


@_register("checksum_fold", _ASCII_FOLD + f""" SELECT c_nationkey AS stream, n::BIGINT AS length, {_CRC}::BIGINT AS crc32,
    ((n + list_sum(list_transform(range(1, n + 1), lambda i: (n - i + 1) * b[i]))) % 65521 * 65536 + (1 + list_sum(b)) % 65521)::BIGINT AS adler32 FROM b""")
def checksum_fold(spark, sf_dir):
    d = _table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", _octets("c_name").alias("o"))
    return checksum.fold(d, "c_nationkey", "c_custkey", "o", xxh=False)


@_register("xxh64_fold", None)
def xxh64_fold(spark, sf_dir):
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", _octets().alias("o"))
    return checksum.fold(d, "conv_id", "turn", "o")


# ---- base 64 and hex ---------------------------------------------------------------------------

@_register("base64_encode", """SELECT doc_id, to_base64(encode(text)) AS standard, translate(to_base64(encode(text)), '+/', '-_') AS url_safe, rtrim(to_base64(encode(text)), '=') AS bare,
    length(to_base64(encode(text)))::BIGINT AS letters, length(rtrim(to_base64(encode(text)), '='))::BIGINT AS bare_letters FROM documents""")
def base64_encode(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", _octets().alias("o"))
    n = F.octet_length("o").cast("bigint")
    return d.select("doc_id", base64.encode(F.col("o")).alias("standard"), base64.encode(F.col("o"), "url_safe").alias("url_safe"), base64.encode(F.col("o"), padding=False).alias("bare"), base64.encoded_len(n).alias("letters"), base64.encoded_len(n, False).alias("bare_letters"))


@_register("base64_decode", """SELECT doc_id, text, CASE WHEN to_base64(encode(text)) SIMILAR TO '.*[+/].*' THEN 'url_safe' END AS alphabet,
    octet_length(encode(text))::BIGINT AS octets FROM documents""")
def base64_decode(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", base64.encode(_octets(), "url_safe", False).alias("b"))
    return d.select("doc_id", base64.decode(F.col("b")).cast("string").alias("text"), base64.alphabet_of(F.col("b")).alias("alphabet"), base64.decoded_len(F.col("b")).alias("octets"))


@_register("base64_refusals", """SELECT * FROM (VALUES ('Zm9v Yg==', 'InvalidCharacter'), ('Zm9vYg==' || chr(10), 'InvalidPadding'), ('a+b_', 'MixedAlphabets'), ('a-b/', 'MixedAlphabets'), ('Zm9vY', 'InvalidLength'),
    ('Zg=', 'InvalidPadding'), ('Zg===', 'InvalidPadding'), ('Z===', 'InvalidPadding'), ('=Zg=', 'InvalidPadding'), ('Zh==', 'NonCanonical'), ('Zm9=', 'NonCanonical'), ('Zh', 'NonCanonical'), ('Zg', NULL)) t(text, error)""")
def base64_refusals(spark, sf_dir):
    cases = ["Zm9v Yg==", "Zm9vYg==\n", "a+b_", "a-b/", "Zm9vY", "Zg=", "Zg===", "Z===", "=Zg=", "Zh==", "Zm9=", "Zh", "Zg"]
    return spark.createDataFrame([(c,) for c in cases], "text string").select("text", base64.try_decode(F.col("text"))["error"].alias("error"))


@_register("hex_and_utf8", "SELECT doc_id, lower(hex(encode(text))) AS hex, true AS utf8, false AS cut FROM documents WHERE text IS NOT NULL")
def hex_and_utf8(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", _octets().alias("o"))
    return d.select("doc_id", json_text.hex_string(F.col("o")).alias("hex"), json_text.is_utf8(F.col("o")).alias("utf8"), json_text.is_utf8(F.concat(F.col("o"), F.lit(b"\xc3"))).alias("cut"))


# ---- JSON --------------------------------------------------------------------------------------

@_register("json_tokens", """SELECT event_id, pos, kind, octets FROM (SELECT event_id, unnest([0, 1, 2, 3]) AS pos, unnest(['begin_object', 'name', 'number', 'end_object']) AS kind,
    unnest([NULL, 'k', json_extract_string(props, '$.k'), NULL]) AS octets FROM events WHERE props IS NOT NULL)""")
def json_tokens(spark, sf_dir):
    d = _table(spark, sf_dir, "events").select("event_id", F.explode(json_text.json_tokens(F.col("props"))).alias("t"))
    return d.select("event_id", "t.pos", "t.kind", F.col("t.octets").cast("string").alias("octets"))


@_register("json_token_rows", "SELECT event_id, count(*) * 4 AS n, 2::BIGINT AS deep FROM events WHERE props IS NOT NULL GROUP BY event_id")
def json_token_rows(spark, sf_dir):
    d = splitters.explode_with(_table(spark, sf_dir, "events").select("event_id", "props"), splitters.tokens, "props")
    return d.groupBy("event_id").agg(F.count("*").alias("n"), F.sum(F.col("depth")).cast("bigint").alias("deep"))


@_register("json_check", "SELECT event_id, json_valid(props) AS ok, NULL::VARCHAR AS error, false AS ok_after FROM events WHERE props IS NOT NULL")
def json_check(spark, sf_dir):
    d = _table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", json_text.json_check(F.col("props")).alias("c"), json_text.json_check(F.concat(F.col("props"), F.lit(" x"))).alias("d"))
    return d.select("event_id", "c.ok", "c.error", F.col("d.ok").alias("ok_after"))


#: Texts and the refusal each must get.
JSON_CASES = [
    ("x", "ExpectedValue"), ("[1,]", "ExpectedValue"), ("{'a':1}", "ExpectedName"), ('{"a":1,}', "ExpectedName"), ('{"a" 1}', "ExpectedNameSeparator"), ("[1 2]", "ExpectedValueSeparator"), ("truex", "TrailingOctets"), ("{} x", "TrailingOctets"),
    ("01", "InvalidNumber"), ("1.e5", "InvalidNumber"), ("nul1", "InvalidLiteral"), ('"\\x"', "InvalidEscape"), ('"\t"', "ControlCharacterInString"), ('"\\ud834"', "LoneSurrogate"), ("[", "Truncated"), ("", "Truncated"), ("NaN", "ExpectedValue"),
    ('{"a":1,"a":2}', None), ("1.50", None), (' "\\ud834\\udd1e" ', None),
]


@_register("json_refusals", "SELECT * FROM (VALUES " + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', {chr(39) + e + chr(39) if e else 'NULL'})" for t, e in JSON_CASES) + ") v(text, error)")
def json_refusals(spark, sf_dir):
    return spark.createDataFrame([(t,) for t, _ in JSON_CASES], "text string").select("text", json_text.json_check(F.col("text"))["error"].alias("error"))


@_register("json_decode", "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k, NULL::VARCHAR AS error FROM events WHERE props IS NOT NULL")
def json_decode(spark, sf_dir):
    kind = T.StructType([T.StructField("k", T.IntegerType(), False)])
    d = _table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", json_text.try_json_decode(F.col("props"), kind).alias("v"))
    return d.select("event_id", F.col("v.value.k").alias("k"), "v.error")


@_register("json_decode_refusals", """SELECT * FROM (VALUES ('{"x":1,"z":2,"y":3}', 'UnknownField'), ('{"x":1,"x":2,"y":3}', 'DuplicateField'), ('{"x":1}', 'MissingField'), ('{"x":true,"y":3}', 'TypeMismatch'), ('[1,2]', 'TypeMismatch'),
    ('{"x":2147483648,"y":3}', 'NumberOutOfRange'), ('{"x":1.5,"y":3}', 'NumberOutOfRange'), ('{"x":1,}', 'ExpectedName'), ('{"x":1', 'Truncated'), ('{"y":1,"x":-0}', NULL)) t(text, error)""")
def json_decode_refusals(spark, sf_dir):
    kind = T.StructType([T.StructField("x", T.IntegerType(), False), T.StructField("y", T.IntegerType(), False)])
    cases = ['{"x":1,"z":2,"y":3}', '{"x":1,"x":2,"y":3}', '{"x":1}', '{"x":true,"y":3}', "[1,2]", '{"x":2147483648,"y":3}', '{"x":1.5,"y":3}', '{"x":1,}', '{"x":1', '{"y":1,"x":-0}']
    return spark.createDataFrame([(c,) for c in cases], "text string").select("text", json_text.try_json_decode(F.col("text"), kind)["error"].alias("error"))


@_register("json_encode", "SELECT doc_id, to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'nothing': NULL::VARCHAR})::VARCHAR AS json FROM documents")
def json_encode(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", json_text.json_encode(F.struct("doc_id", "text", "lang", F.lit(None).cast("string").alias("nothing"))).alias("json"))


@_register("json_rewrite", "SELECT event_id, replace(props, ': ', ':') AS json FROM events WHERE props IS NOT NULL")
def json_rewrite(spark, sf_dir):
    d = _table(spark, sf_dir, "events").where("props IS NOT NULL")
    return d.select("event_id", json_text.try_json_from_tokens(json_text.json_tokens(F.col("props")))["value"].alias("json"))


@_register("json_numbers", "SELECT o_orderkey, true AS plain, false AS zero_led, false AS pointed FROM orders")
def json_numbers(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("n"))
    return d.select("o_orderkey", json_text.is_json_number(F.col("n")).alias("plain"), json_text.is_json_number(F.concat(F.lit("0"), F.regexp_replace("n", "^-", ""))).alias("zero_led"), json_text.is_json_number(F.concat(F.split("n", "\\.")[0], F.lit("."))).alias("pointed"))


@_register("decimal_text", "SELECT o_orderkey, printf('%d.%02d', floor(round(o_totalprice * 100) / 100)::BIGINT, (round(o_totalprice * 100)::BIGINT % 100)) AS price FROM orders")
def decimal_text(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return _table(spark, sf_dir, "orders").select("o_orderkey", json_text.decimal_text(cents < 0, F.floor(cents / 100).cast("bigint"), cents % 100, 2).alias("price"))


@_register("json_sequence", """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS ordinal,
    to_json({'turn': turn, 'role': role, 'text': text})::VARCHAR AS text, NULL::VARCHAR AS error FROM conversations""")
def json_sequence(spark, sf_dir):
    """One sequence a conversation, written and taken apart again."""
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", json_text.sequence_record(json_text.json_encode(F.struct("turn", "role", "text"))).alias("r"))
    d = d.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "r"))), lambda x: x["r"]), "").alias("s"))
    made = splitters.explode_with(d, splitters.texts, "s")
    return made.select("conv_id", "ordinal", F.rtrim(F.regexp_replace(F.col("value").cast("string"), "\n$", "")).alias("text"), "error")


# ---- chunked streams ---------------------------------------------------------------------------

def _through_stream(spark: SparkSession, chunks: DataFrame, work: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Chunks by way of files through a streaming query; rows of every micro-batch as a table."""
    import uuid

    base = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{base}/in")
    out = work(spark.readStream.schema(chunks.schema).parquet(f"{base}/in"))

    def keep(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={k}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def _chunks(spark: SparkSession, sf_dir: str, codec: str) -> DataFrame:
    """A coded stream a conversation, in chunks of 100 octets."""
    d = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("t"))
    d = d.select(F.col("conv_id").alias("stream"), codecs.encode(F.encode("t", "UTF-8"), codec).alias("c"))
    n = F.ceil(F.octet_length("c") / 100).cast("int")
    d = d.select("stream", "c", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return d.select("stream", F.col("k").cast("bigint").alias("seq"), F.expr("substring(c, k * 100 + 1, 100)").alias("chunk"), (F.col("k") == F.col("n") - 1).alias("last"))


def _part_query(codec: str) -> None:
    @_register(f"{codec}_parts", "SELECT conv_id AS stream, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
    def parts(spark, sf_dir):
        """A stream a conversation, flushed after each turn; its parts together decode to the turns together."""
        from .streaming import encoders

        d = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").alias("seq"), _octets().alias("chunk"))
        return _whole_streams(encoders.encode_parts(d, codec), codec)


def _whole_streams(parts: DataFrame, codec: str) -> DataFrame:
    hexed = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "part"))), lambda x: F.hex(x["part"]))
    made = parts.groupBy("stream").agg(F.unhex(F.array_join(hexed, "")).alias("c"))
    return made.select("stream", codecs.decode(F.col("c"), codec).cast("string").alias("text"))


for _codec in CODECS:
    _part_query(_codec)


def _encode_stream_query(codec: str) -> None:
    @_register(f"{codec}_encode_stream", "SELECT conv_id AS stream, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
    def encode_stream(spark, sf_dir):
        """As above, by a streaming query whose state carries the encoder on."""
        from pyspark.sql import Window

        from .streaming import encoders

        by = Window.partitionBy("conv_id")
        d = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").cast("bigint").alias("seq"), _octets().alias("chunk"), (F.col("turn") == F.max("turn").over(by)).alias("last"))
        return _whole_streams(_through_stream(spark, d, lambda s: encoders.encode_stream(s, codec), "append"), codec)


for _codec in ("gzip", "zlib", "deflate"):
    _encode_stream_query(_codec)


def _stream_query(codec: str) -> None:
    @_register(f"{codec}_stream", "SELECT conv_id AS stream, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
    def stream(spark, sf_dir):
        from .streaming import chunks

        out = _through_stream(spark, _chunks(spark, sf_dir, codec), lambda s: chunks.decode(s, codec), "append")
        return out.where("status = 'member'").select("stream", F.col("value").cast("string").alias("text"))


for _codec in CODECS:
    _stream_query(_codec)


@_register("checksum_stream", _ASCII_FOLD + f""" SELECT c_nationkey AS stream, n::BIGINT AS length, {_CRC}::BIGINT AS crc32,
    ((n + list_sum(list_transform(range(1, n + 1), lambda i: (n - i + 1) * b[i]))) % 65521 * 65536 + (1 + list_sum(b)) % 65521)::BIGINT AS adler32 FROM b""")
def checksum_stream(spark, sf_dir):
    from .streaming import chunks

    d = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("stream"), F.col("c_custkey").alias("seq"), _octets("c_name").alias("chunk")).coalesce(1)
    out = _through_stream(spark, d, chunks.checksums, "update")
    return out.groupBy("stream").agg(F.max(F.struct("length", "crc32", "adler32")).alias("x")).select("stream", "x.length", "x.crc32", "x.adler32")


# ---- coded files -------------------------------------------------------------------------------

@_register("gzip_text_files", "SELECT n_name AS value FROM nation")
def gzip_text_files(spark, sf_dir):
    """Spark's own gzip text sink and source."""
    import uuid

    base = f"{_shared(spark)}/text-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).write.option("compression", "gzip").text(base)
    return spark.read.text(base)


def _shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where all tasks share the machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return named.rstrip("/")


def _file_query(codec: str) -> None:
    @_register(f"{codec}_files", "SELECT doc_id, text FROM documents")
    def files(spark, sf_dir):
        """Records `doc_id:base64;` of all documents, written to coded files and read back."""
        import uuid

        from .sources import files as source

        source.register(spark)
        folder = f"{_shared(spark)}/coded-{uuid.uuid4().hex}"
        record = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce(F.base64(_octets()), F.lit("!")), F.lit(";"))
        d = _table(spark, sf_dir, "documents").select(F.encode(record, "UTF-8").alias("value"))
        d.write.format("coded").option("path", folder).option("codec", codec).option("max_file_len", 32 << 20).mode("append").save()
        back = source.read_coded(spark, f"{folder}/part-*", codec)
        back = back.select(F.explode(F.split(F.col("value").cast("string"), ";")).alias("r")).where("r <> ''")
        held = F.substring_index("r", ":", -1)
        return back.select(F.substring_index("r", ":", 1).cast("bigint").alias("doc_id"), F.when(held != "!", F.unbase64(held).cast("string")).alias("text"))


for _codec in CODECS:
    _file_query(_codec)


@_register("json_sequence_files", "SELECT to_json({'n': n_nationkey, 'name': n_name})::VARCHAR AS text, NULL::VARCHAR AS error FROM nation")
def json_sequence_files(spark, sf_dir):
    import uuid

    from .sources import files as source

    source.register(spark)
    folder = f"{_shared(spark)}/seq-{uuid.uuid4().hex}"
    d = _table(spark, sf_dir, "nation").select(F.encode(json_text.json_encode(F.struct(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"))), "UTF-8").alias("value"))
    d.write.format("coded").option("path", folder).option("codec", "jsonseq").mode("append").save()
    return source.read_json_sequence(spark, f"{folder}/part-*").select("text", "error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
