"""Reversible transforms of machine code: relative targets become absolute, so equal calls become equal bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Opcodes of one byte, and second bytes of those of two, whose operand can be relative to the instruction pointer.
OPCODES_1 = (
    0x01, 0x03, 0x09, 0x0B, 0x21, 0x23, 0x29, 0x2B, 0x31, 0x33, 0x38, 0x39, 0x3A, 0x3B, 0x63, 0x80, 0x81, 0x83, 0x84, 0x85, 0x88, 0x89, 0x8A, 0x8B, 0x8D, 0xC6, 0xC7, 0xF7, 0xFF,
)
OPCODES_2 = (
    0x10, 0x11, 0x12, 0x13, 0x16, 0x17, 0x28, 0x29, 0x2A, 0x2E, 0x2F, 0x51, 0x54, 0x57, 0x58, 0x59, 0x5A, 0x5C, 0x5E, 0x6F, 0x74, 0x76, 0x7F, 0xB6, 0xB7, 0xBE, 0xBF, 0xD6, 0xDB, 0xEB, 0xEF,
)


def _set(codes: tuple[int, ...]) -> bytes:
    return b"[" + re.escape(bytes(codes)) + b"]"


#: ModRM bytes with mod 00 and r/m 101.
_RELATIVE = b"[\\x05\\x0d\\x15\\x1d\\x25\\x2d\\x35\\x3d]"
_OPERAND = b"(?:\\x0f" + _set(OPCODES_2) + _RELATIVE + b"|" + _set(OPCODES_1) + _RELATIVE + b")"
_PREFIXES = b"[\\x66\\xf2\\xf3]?[\\x40-\\x4f]?"


def _pattern(calls: bytes) -> re.Pattern:
    """One address field of four bytes in each match, right after group 1."""
    return re.compile(b"(" + calls + b"|" + _PREFIXES + _OPERAND + b")(?s:....)", re.DOTALL)


_IN_PLACE, _SPLIT, _CALLS = _pattern(b"[\\xe8\\xe9]"), _pattern(b"\\xe8"), re.compile(b"([\\xe8\\xe9])....", re.DOTALL)


def _moved(v: int, by: int, bits: int) -> int:
    """v + by, kept within its signed range of bits + 1 bits; values outside the range stay as they are."""
    if (v >> bits) not in (0, 0xFFFFFFFF >> bits):
        return v
    mask = 0xFFFFFFFF >> (31 - bits)
    r = (v + by) & mask
    return r | (0xFFFFFFFF ^ mask) if r >> bits else r


def _in_place(pattern: re.Pattern, data: bytes, sign: int) -> bytes:
    out = bytearray(data)
    for m in pattern.finditer(data):
        f = m.end(1)
        out[f : f + 4] = _moved(int.from_bytes(data[f : f + 4], "little"), sign * m.start(), 23).to_bytes(4, "little")
    return bytes(out)


def arm64(data: bytes, sign: int) -> bytes:
    words = np.frombuffer(data[: len(data) // 4 * 4], "<u4").copy()
    call = (words & 0xFC000000) == 0x94000000
    at = np.flatnonzero(call).astype(np.int64)
    words[at] = 0x94000000 | ((words[at].astype(np.int64) & 0x03FFFFFF) + sign * at & 0x03FFFFFF).astype(np.uint32)
    return words.tobytes() + data[len(words) * 4 :]


def range_bits(n: int) -> int:
    """Bits of the converted range for a file of n bytes: 23 to 31."""
    return min(31, max(23, (n - 1).bit_length())) if n > 1 else 23


def split_encode(data: bytes) -> bytes:
    """Address fields move to the end, the last one first and big-endian."""
    bits, code, tail, at = range_bits(len(data)), [], [], 0
    for m in _SPLIT.finditer(data):
        f = m.end(1)
        code.append(data[at:f])
        tail.append(_moved(int.from_bytes(data[f : f + 4], "little"), m.start(), bits).to_bytes(4, "big"))
        at = f + 4
    return b"".join([*code, data[at:], *reversed(tail)])


def split_decode(data: bytes) -> bytes:
    bits, out, made, q, end = range_bits(len(data)), [], 0, 0, len(data)
    heads = re.compile(_SPLIT.pattern.removesuffix(b"(?s:....)"), re.DOTALL)
    # in the code that is left a field's four bytes are missing, but they still have to fit before the end
    while m := heads.search(data, q, end):
        if m.end(1) + 4 > end:
            shorter = _shorter(heads, data, m, end)
            if shorter is None:
                break
            m = shorter
        out.append(data[q : m.end(1)])
        made += m.end(1) - q
        end -= 4
        pos = made - (m.end(1) - m.start())
        out.append(_moved(int.from_bytes(data[end : end + 4], "big"), -pos, bits).to_bytes(4, "little"))
        made += 4
        q = m.end(1)
    return b"".join([*out, data[q:end]])


def _shorter(heads: re.Pattern, data: bytes, m: re.Match, end: int) -> re.Match | None:
    """The next match whose field fits, after one whose field doesn't."""
    at = m.start() + 1
    while n := heads.search(data, at, end):
        if n.end(1) + 4 <= end:
            return n
        at = n.start() + 1
    return None


def apply(transform: int, data: bytes, encode: bool = True) -> bytes:
    sign = 1 if encode else -1
    if transform == 0:
        return data
    if transform == 1:
        return _in_place(_CALLS, data, sign)
    if transform == 2:
        return arm64(data, sign)
    if transform == 3:
        return _in_place(_IN_PLACE, data, sign)
    if transform == 4:
        return split_encode(data) if encode else split_decode(data)
    raise ValueError(f"unknown transform {transform}")


def safe(transform: int, data: bytes) -> tuple[int, bytes]:
    """The transform if it comes back, else a simpler one: 4, 3, 1, none."""
    for t in [transform, *(x for x in (3, 1) if x < transform and transform in (3, 4)), 0]:
        done = apply(t, data)
        if apply(t, done, False) == data:
            return t, done
    return 0, data


@F.arrow_udf(T.StructType([T.StructField("transform", T.ShortType()), T.StructField("data", T.BinaryType())]))
def transformed(transform: pa.Array, data: pa.Array) -> pa.Array:
    pairs = [safe(int(t), d) if d is not None else (0, None) for t, d in zip(transform.to_pylist(), data.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in pairs], pa.int16()), pa.array([d for _, d in pairs], pa.binary())], ["transform", "data"])


@F.arrow_udf(T.BinaryType())
def restored(transform: pa.Array, data: pa.Array) -> pa.Array:
    return pa.array([None if d is None else apply(int(t), d, False) for t, d in zip(transform.to_pylist(), data.to_pylist(), strict=True)], pa.binary())
