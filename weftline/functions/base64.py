"""Base 64 of RFC 4648: built-in encoding, strict decoding with every refusal named."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import judged
from .verdict import Refused, unwrap

STANDARD, URL_SAFE, EITHER = "standard", "url_safe", "either"


def encode(octets: Column, alphabet: str = STANDARD, padding: bool = True) -> Column:
    """Built in. Spark breaks long texts into lines unless told otherwise, so line ends are taken out."""
    text = F.translate(F.base64(octets), "\r\n", "")
    if alphabet == URL_SAFE:
        text = F.translate(text, "+/", "-_")
    return text if padding else F.translate(text, "=", "")


def encoded_len(n: Column, padding: bool = True) -> Column:
    """Letters of a text of n octets."""
    whole, rest = F.floor(n / 3).cast("bigint") * 4, F.pmod(n, F.lit(3)).cast("bigint")
    return F.when(rest == 0, whole).otherwise(whole + (F.lit(4) if padding else rest + 1)).cast("bigint")


def decoded_len(text: Column) -> Column:
    """Octets a text decodes to, from its length and pads alone; null where those refuse it."""
    n = F.length(text).cast("bigint")
    pads = F.when(text.endswith("=="), 2).when(text.endswith("="), 1).otherwise(0).cast("bigint")
    letters, rest = n - pads, F.pmod(n - pads, F.lit(4)).cast("bigint")
    whole = F.floor(letters / 4).cast("bigint") * 3
    return F.when((pads > 0) & (F.pmod(n, F.lit(4)) != 0), F.lit(None)).when(rest == 1, F.lit(None)).when(rest == 0, whole).otherwise(whole + rest - 1).cast("bigint")


def alphabet_of(text: Column) -> Column:
    """The alphabet a text's letters of values 62 and 63 belong to, or null."""
    return F.when(text.rlike("[+/]"), STANDARD).when(text.rlike("[-_]"), URL_SAFE)


_FOREIGN = {EITHER: re.compile(rb"[^A-Za-z0-9+/_=-]"), STANDARD: re.compile(rb"[^A-Za-z0-9+/=]"), URL_SAFE: re.compile(rb"[^A-Za-z0-9_=-]")}
_ONLY = {STANDARD: re.compile(rb"[+/]"), URL_SAFE: re.compile(rb"[-_]")}


def decode_octets(text: bytes, accept: str = EITHER, padding: str = "optional", pad_bits: str = "refuse", max_output_len: int | None = None) -> bytes:
    """The octets of a text, or Refused; errors are found in the order of the text."""
    pad = text.find(b"=")
    letters = text if pad < 0 else text[:pad]
    bad = [(m.start(), "InvalidCharacter") for m in [_FOREIGN[accept].search(letters)] if m]
    if accept == EITHER:
        first = {k: m.start() for k, r in _ONLY.items() if (m := r.search(letters))}
        if len(first) == 2:
            bad.append((max(first.values()), "MixedAlphabets"))
    if bad:
        at, error = min(bad)
        raise Refused(error, at)
    held = len(letters) % 4
    if pad >= 0:
        if padding == "refused" or held < 2:
            raise Refused("InvalidPadding", pad)
    elif held == 1:
        raise Refused("InvalidLength", len(text))
    elif held and padding == "required":
        raise Refused("InvalidPadding", len(text))
    filled = letters.translate(bytes.maketrans(b"-_", b"+/")) + b"=" * (-len(letters) % 4)
    out = base64.b64decode(filled)
    # a quantum's unused bits are judged where its letters end, before the pads after it
    if pad_bits == "refuse" and held and base64.b64encode(out) != filled:
        raise Refused("NonCanonical", max(0, len(letters) - 1))
    if pad >= 0 and text[pad:] != b"=" * (4 - held):
        raise Refused("InvalidPadding", min(len(text), pad + 4 - held))
    if max_output_len is not None and len(out) > max_output_len:
        raise Refused("NoSpaceLeft")
    return out


def try_decode(text: Column, accept: str = EITHER, padding: str = "optional", pad_bits: str = "refuse", max_output_len: int | None = None) -> Column:
    return judged(lambda b: (decode_octets(b, accept, padding, pad_bits, max_output_len), len(b)))(text)


def decode(text: Column, accept: str = EITHER, padding: str = "optional", pad_bits: str = "refuse", max_output_len: int | None = None) -> Column:
    return unwrap(try_decode(text, accept, padding, pad_bits, max_output_len))
