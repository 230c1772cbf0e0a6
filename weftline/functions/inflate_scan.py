"""A plain DEFLATE reader that names what is wrong with a stream.

The native library decodes; this one is asked when it refuses, for the error's name, and for streams that declare a
window below 32 KiB, whose distances the native library doesn't hold against it.
"""

from __future__ import annotations

from .verdict import Refused

#: Fixed values of RFC 1951: base and extra bits of length and distance symbols, order of code length codes.
LENGTHS = [(3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0), (10, 0), (11, 1), (13, 1), (15, 1), (17, 1), (19, 2), (23, 2), (27, 2), (31, 2), (35, 3), (43, 3), (51, 3), (59, 3), (67, 4), (83, 4), (99, 4), (115, 4), (131, 5), (163, 5), (195, 5), (227, 5), (258, 0)]
DISTANCES = [(1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (7, 1), (9, 2), (13, 2), (17, 3), (25, 3), (33, 4), (49, 4), (65, 5), (97, 5), (129, 6), (193, 6), (257, 7), (385, 7), (513, 8), (769, 8), (1025, 9), (1537, 9), (2049, 10), (3073, 10), (4097, 11), (6145, 11), (8193, 12), (12289, 12), (16385, 13), (24577, 13)]
ORDER = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            if self.at == len(self.data):
                raise Refused("Truncated")
            self.held |= self.data[self.at] << self.n
            self.at += 1
            self.n += 8
        out = self.held & ((1 << k) - 1)
        self.held >>= k
        self.n -= k
        return out

    def align(self) -> None:
        self.held >>= self.n % 8
        self.n -= self.n % 8


def _code(lengths: list[int], lone: bool) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol. lone: a single code of one bit, or none, may be incomplete."""
    used = [x for x in lengths if x]
    left = (1 << 15) - sum(1 << (15 - x) for x in used)
    if left < 0:
        raise Refused("OverSubscribedCode")
    if left > 0 and not (lone and (not used or used == [1])):
        raise Refused("IncompleteCode")
    out, code = {}, 0
    for n in range(1, 16):
        for symbol, x in enumerate(lengths):
            if x == n:
                out[n, code] = symbol
                code += 1
        code <<= 1
    return out


def _symbol(bits: _Bits, code: dict[tuple[int, int], int]) -> int:
    value = 0
    for n in range(1, 16):
        value = value << 1 | bits.take(1)
        symbol = code.get((n, value))
        if symbol is not None:
            return symbol
    raise Refused("InvalidCode")


_FIXED = _code([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8, False), _code([5] * 32, False)


def _dynamic(bits: _Bits):
    literals, distances, n = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
    if literals > 286:
        raise Refused("TooManyLiteralLengthCodes")
    first = [0] * 19
    for k in ORDER[:n]:
        first[k] = bits.take(3)
    code, lengths = _code(first, False), []
    while len(lengths) < literals + distances:
        s = _symbol(bits, code)
        if s < 16:
            lengths.append(s)
            continue
        if s == 16 and not lengths:
            raise Refused("RepeatWithoutLength")
        value, count = (lengths[-1], 3 + bits.take(2)) if s == 16 else (0, 3 + bits.take(3)) if s == 17 else (0, 11 + bits.take(7))
        if len(lengths) + count > literals + distances:
            raise Refused("RepeatPastEnd")
        lengths += [value] * count
    if not lengths[256]:
        raise Refused("MissingEndOfBlock")
    return _code(lengths[:literals], True), _code(lengths[literals:], True)


def scan(data: bytes, window: int = 1 << 15) -> int:
    """Octets of the stream at the start of data, or Refused with the first error's name."""
    bits, written = _Bits(data), 0
    last = 0
    while not last:
        last, kind = bits.take(1), bits.take(2)
        if kind == 3:
            raise Refused("InvalidBlockType")
        if kind == 0:
            bits.align()
            n, check = bits.take(16), bits.take(16)
            if n ^ check != 0xFFFF:
                raise Refused("StoredLengthMismatch")
            whole = bits.n // 8
            bits.at -= whole
            bits.held = bits.n = 0
            if bits.at + n > len(data):
                raise Refused("Truncated")
            bits.at += n
            written += n
            continue
        literals, distances = _FIXED if kind == 1 else _dynamic(bits)
        while True:
            s = _symbol(bits, literals)
            if s < 256:
                written += 1
            elif s == 256:
                break
            elif s > 285:
                raise Refused("InvalidLiteralLength")
            else:
                base, extra = LENGTHS[s - 257]
                length = base + bits.take(extra)
                d = _symbol(bits, distances)
                if d > 29:
                    raise Refused("InvalidDistance")
                base, extra = DISTANCES[d]
                if base + bits.take(extra) > min(written, window):
                    raise Refused("DistanceTooFar")
                written += length
    return bits.at - bits.n // 8
