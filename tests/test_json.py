"""Refusal tables, splits and round trips of the JSON functions."""

import pytest

from weftline.functions.json_text import check, decode_value, from_tokens, quote, sequence_texts, tokens
from weftline.functions.verdict import Refused, class_of

TEXTS = {
    "ByteOrderMark": [b"\xef\xbb\xbf{}", b"\xef\xbb\xbf"],
    "ExpectedValue": [b"\xef", b"\xef\xbb", b"\xef\xbbx", b"x", b"+1", b".5", b"True", b"'a'", b"[,]", b"[1,]", b'{"a":}', b'{"a":,}', b"\xc3\xa9", b"\x00", b"]", b","],
    "InvalidLiteral": [b"tru ", b"trUe", b"nul1", b"nil", b"[tru]"],
    "InvalidNumber": [b"01", b"-01", b"00", b"- 1", b"-a", b"1.e5", b"[1.]", b"[-]", b"1.5e+e", b"0.x", b"[1e]", b"[1e+]"],
    "ControlCharacterInString": [b'"a\x01"', b'"\n"', b'"\x00"', b'["\t"]', b'"\x1e"'],
    "InvalidEscape": [b'"\\x"', b'"\\U0041"', b'"\\u12G4"', b'"\\u004"', b"\"\\'\"", b'"\\ "', b'"\\u"'],
    "InvalidUtf8": [b'"\xc3\x28"', b'"\xc3"', b'"\xed\xa0\x80"', b'"\xff"', b'"\xc0\x80"', b'"\x80"', b'"\xf4\x90\x80\x80"', b'"\xe2\x82\\n"', b'{"\xfe":1}'],
    "ExpectedName": [b"{1:2}", b'{"a":1,}', b"{,}", b"{null:1}"],
    "ExpectedNameSeparator": [b'{"a" 1}', b'{"a",1}', b'{"a"}'],
    "ExpectedValueSeparator": [b"[1 2]", b"[1}", b'{"a":1]', b"[[]}", b"[1:2]"],
    "TrailingOctets": [b"{} x", b"1 2", b'"a""b"', b"[]]", b"null,", b"truex", b"1x", b"[] \x1e"],
    "DepthTooLarge": [b"[" * 1025],
    "LoneSurrogate": [b'"\\uD834"', b'"\\uDD1E"', b'"\\uD834\\u0041"', b'"\\uD834x"', b'"\\uD834\\uD834"'],
    "Truncated": [b"", b" ", b"fals", b"-", b"1.", b"1e+", b'"\\"', b'"\\u00', b'"\\uD834', b'"\xe2\x82', b"[", b'{"a":', b"[1,"],
}
SEQUENCES = {
    "MissingRecordSeparator": [b"{}", b" \x1e{}", b"1\n"],
    "IncompleteText": [b"\x1e{\x1e", b'\x1e"ab\x1e', b"\x1etr\x1e", b"\x1e \x1e1\n", b"\x1e[1,\x1e"],
    "UndelimitedValue": [b"\x1e123\x1e", b"\x1etrue", b"\x1e123", b"\x1enull\x1e{}\n", b"\x1e-0"],
    "Truncated": [b"", b"\x1e", b"\x1e\x1e", b"\x1e ", b"\x1e["],
}


@pytest.mark.parametrize("error,text", [(e, t) for e, ts in TEXTS.items() for t in ts])
def test_refusals(error, text):
    with pytest.raises(Refused) as found:
        check(text)
    assert found.value.error == error


@pytest.mark.parametrize("error,text", [(e, t) for e, ts in SEQUENCES.items() for t in ts])
def test_sequence_refusals(error, text):
    assert next(e for _, _, e in sequence_texts(text) if e) == error


def test_classes():
    assert [class_of(e) for e in ("DepthTooLarge", "LoneSurrogate", "Truncated", "NoSpaceLeft", "InvalidUtf8", None)] == ["unsupported", "unsupported", "incomplete", "incomplete", "corrupt", None]


def test_tokens_keep_text():
    text = b' {"a":[1,2.50,-0,1e5,"x\\n\\u00e9\\ud834\\udd1e",null,true,false],"a":{}} '
    got = [(k, v) for k, _, v in tokens(text)]
    assert ("number", b"2.50") in got and [v for k, v in got if k == "name"] == [b"a", b"a"]
    assert from_tokens(got) == '{"a":[1,2.50,-0,1e5,"x\\né\U0001d11e",null,true,false],"a":{}}'
    assert list(tokens(b"[" * 1024 + b"]" * 1024))


def test_writer():
    assert quote(b'\x00\x1f"\\/\x7f\xc3\xa9\n') == '"\\u0000\\u001f\\"\\\\/\x7fé\\n"'
    assert from_tokens([("begin_array", None), ("hex", b"\x00\xff"), ("base64", b"\xfb"), ("decimal", b"-0.50"), ("end_array", None)]) == '["00ff","+w==",-0.50]'
    for items, error in (([("string", b"\xff")], "InvalidUtf8"), ([("number", b"01")], "InvalidNumber"), ([("begin_array", None)] * 1025, "DepthTooLarge"), ([("name", b"a")], "UnexpectedToken"), ([("begin_array", None)], "Truncated")):
        with pytest.raises(Refused) as found:
            from_tokens(items)
        assert found.value.error == error


def test_typed_values():
    from pyspark.sql import types as T

    point = T.StructType([T.StructField("x", T.IntegerType(), False), T.StructField("y", T.IntegerType(), False)])
    record = T.StructType([
        T.StructField("name", T.StringType(), False), T.StructField("count", T.IntegerType(), False, {"unsigned": 16}), T.StructField("ratio", T.DecimalType(38, 18), False),
        T.StructField("color", T.StringType(), False, {"enum": ["red", "green"]}), T.StructField("nickname", T.StringType(), True), T.StructField("origin", point, True),
        T.StructField("flags", T.ArrayType(T.BooleanType(), False), False, {"length": 3}), T.StructField("limit", T.IntegerType(), False, {"default": 9}),
    ])
    text = b'{"name":"caf\xc3\xa9","count":7,"ratio":-1.25,"color":"green","nickname":null,"origin":{"y":4,"x":-3},"flags":[true,false,true]}'
    got = decode_value(text, record)
    assert got["name"] == "café" and str(got["ratio"]) == "-1.25" and got["origin"] == {"x": -3, "y": 4} and got["limit"] == 9 and got["nickname"] is None
    cases = [
        (point, b'{"x":1,"z":2,"y":3}', "UnknownField"), (point, b'{"x":1,"x":2,"y":3}', "DuplicateField"), (point, b'{"x":1}', "MissingField"), (point, b'{"x":true,"y":3}', "TypeMismatch"), (point, b"[1,2]", "TypeMismatch"),
        (T.ByteType(), b"300", "NumberOutOfRange"), (T.ByteType(), b"-129", "NumberOutOfRange"), (T.ByteType(), b"1e2", "NumberOutOfRange"), (T.BooleanType(), b"1", "TypeMismatch"), (point, b'{"x":1', "Truncated"), (point, b'{"x":1,}', "ExpectedName"),
        (T.DecimalType(20, 0), b"18446744073709551616", "NumberOutOfRange"),
    ]
    for kind, data, error in cases:
        with pytest.raises(Refused) as found:
            decode_value(data, kind)
        assert found.value.error == error
    for meta, data, error in (({"length": 2}, b"[1]", "ArrayLength"), ({"length": 2}, b"[1,2,3]", "ArrayLength")):
        with pytest.raises(Refused) as found:
            decode_value(data, T.ArrayType(T.IntegerType(), False), meta=meta)
        assert found.value.error == error
    assert decode_value(b" -128 ", T.ByteType()) == -128 and decode_value(b"null", T.BooleanType(), True) is None
