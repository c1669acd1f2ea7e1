"""Byte codecs and hashes of the record formats, as Python functions and as columns.

Fixed widths are little-endian; a varint holds seven bits a byte, least first.
Columns are Spark expressions where Spark has the parts, else pandas UDFs over
whole batches in numpy (run lengths and the 128-bit hash go row by row).  Hash
columns are unsigned values in a long (64-bit ones wrap to negative numbers).
Bytes of 0x80 and more count as 128..255; ``signed=True`` of fnv1a and
slice_hash takes them for -128..-1, as C does where char is signed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_M32, _M64 = (1 << 32) - 1, (1 << 64) - 1


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(value, position after it); ValueError when cut off or too large."""
    n = shift = 0
    while at < len(data) and shift < bits:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            if n >> bits:
                break
            return n, at
    raise ValueError("bad varint")


def length_prefixed(data: bytes) -> bytes:
    return varint(len(data)) + data


def read_length_prefixed(data: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = read_varint(data, at, 32)
    if at + n > len(data):
        raise ValueError("cut off")
    return data[at : at + n], at + n


def internal_key(key: bytes, seq: int, op: int) -> bytes:
    return key + (seq << 8 | op).to_bytes(8, "little")


def read_internal_key(data: bytes) -> tuple[bytes, int, int]:
    if len(data) < 8:
        raise ValueError("too short")
    tag = int.from_bytes(data[-8:], "little")
    return data[:-8], tag >> 8, tag & 255


def fnv1a(data: bytes, bits: int = 32, signed: bool = False) -> int:
    # Fixed values of the FNV-1a hash: offset basis and prime.
    h, prime, mask = (0x811C9DC5, 0x01000193, _M32) if bits == 32 else (0xCBF29CE484222325, 0x100000001B3, _M64)
    for b in data:
        h = (h ^ (b - 256 if signed and b > 127 else b)) * prime & mask
    return h


def slice_hash(data: bytes, signed: bool = False) -> int:
    """Polynomial of the bytes at 31, 64 bits."""
    h = 0
    for b in data:
        h = (h * 31 + (b - 256 if signed and b > 127 else b)) & _M64
    return h


def crc_mask(crc: int) -> int:
    """A checksum that is stored beside data that holds checksums itself: rotated and moved by a fixed value."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & _M32


def crc_unmask(masked: int) -> int:
    x = masked - 0xA282EAD8 & _M32
    return (x >> 17 | x << 15) & _M32


def hash32(data: bytes, seed: int = 0) -> int:
    """MurmurHash2's mixing, 32 bits, from the seed alone."""
    return int(hash32_many([data], seed)[0])


def hash64(data: bytes, seed: int = 0) -> int:
    """MurmurHash64A."""
    return int(hash64_many([data], [seed])[0])


def city32(data: bytes) -> int:
    """hash32 up to 4 bytes; beyond, MurmurHash3's rounds over whole words, seeded by the length, without its end."""
    if len(data) <= 4:
        return hash32(data)
    return int(_rounds([data], np.array([len(data)], np.uint64))[0])


def city64(data: bytes) -> int:
    return hash64(data, 0 if len(data) <= 8 else len(data))


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """MurmurHash3, x64, 128 bits: its two halves."""
    rot = lambda x, r: (x << r | x >> (64 - r)) & _M64
    # Fixed values of the published hash.
    k1, k2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    stir = lambda a, b: (rot(a[0] * k1 & _M64, 31) * k2 & _M64, rot(b[0] * k2 & _M64, 33) * k1 & _M64)
    h1 = h2 = seed
    whole = len(data) // 16 * 16
    for i in range(0, whole, 16):
        a, b = (int.from_bytes(data[j : j + 8], "little") for j in (i, i + 8))
        x, y = stir((a,), (b,))
        h1 = ((rot(h1 ^ x, 27) + h2) * 5 + 0x52DCE729) & _M64
        h2 = ((rot(h2 ^ y, 31) + h1) * 5 + 0x38495AB5) & _M64
    a, b = (int.from_bytes(data[whole:][j : j + 8], "little") for j in (0, 8))
    x, y = stir((a,), (b,))
    h1, h2 = h1 ^ x ^ len(data), h2 ^ y ^ len(data)

    def end(h: int) -> int:
        for mul in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * mul & _M64
        return h ^ h >> 33

    h1 = h1 + h2 & _M64
    h2 = h2 + h1 & _M64
    h1, h2 = end(h1), end(h2)
    h1 = h1 + h2 & _M64
    return h1, h2 + h1 & _M64


def _words(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as rows of little-endian words, padded by zeros, and their lengths."""
    n = np.array([len(x) for x in data], np.int64)
    wide = -(-int(n.max(initial=0)) // width) * width + width
    flat = b"".join(x.ljust(wide, b"\0") for x in data)
    return np.frombuffer(flat, f"<u{width}").reshape(len(data), wide // width).astype(np.uint64), n


_W32 = np.uint64(_M32)


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r) | x >> np.uint64(32 - r)) & _W32


def _rounds(data: list[bytes], h: np.ndarray) -> np.ndarray:
    """MurmurHash3's rounds over the whole words of every text."""
    # Fixed values of the published hash.
    c1, c2, five, add = (np.uint64(c) for c in (0xCC9E2D51, 0x1B873593, 5, 0xE6546B64))
    words, n = _words(data, 4)
    for i in range(int(n.max(initial=0)) // 4):
        k = _turn(words[:, i] * c1 & _W32, 15) * c2 & _W32
        h = np.where(i < n // 4, _turn(h ^ k, 13) * five + add & _W32, h)
    return h


def murmur3_many(data: list[bytes], seed: int = 0) -> np.ndarray:
    h = _rounds(data, np.full(len(data), seed, np.uint64))
    words, n = _words(data, 4)
    tail = words[np.arange(len(data)), n // 4]
    h ^= _turn(tail * np.uint64(0xCC9E2D51) & _W32, 15) * np.uint64(0x1B873593) & _W32
    h ^= n.astype(np.uint64)
    for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(mul) & _W32
    return h


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3, x86, 32 bits."""
    return int(murmur3_many([data], seed)[0])


def hash32_many(data: list[bytes], seed: int = 0) -> np.ndarray:
    m = np.uint64(0x5BD1E995)  # fixed value of the published hash
    words, n = _words(data, 4)
    h = np.full(len(data), seed, np.uint64)
    for i in range(int(n.max(initial=0)) // 4):
        k = words[:, i] * m & _W32
        k = (k ^ k >> np.uint64(24)) * m & _W32
        h = np.where(i < n // 4, h * m & _W32 ^ k, h)
    tail = words[np.arange(len(data)), n // 4]
    h = np.where(n % 4 > 0, (h ^ tail) * m & _W32, h)
    h = (h ^ h >> np.uint64(13)) * m & _W32
    return h ^ h >> np.uint64(15)


def hash64_many(data: list[bytes], seeds) -> np.ndarray:
    m, r = np.uint64(0xC6A4A7935BD1E995), np.uint64(47)  # fixed values of the published hash
    words, n = _words(data, 8)
    h = np.array(seeds, np.uint64) ^ n.astype(np.uint64) * m
    for i in range(int(n.max(initial=0)) // 8):
        k = words[:, i] * m
        k = (k ^ k >> r) * m
        h = np.where(i < n // 8, (h ^ k) * m, h)
    tail = words[np.arange(len(data)), n // 8]
    h = np.where(n % 8 > 0, (h ^ tail) * m, h)
    h = (h ^ h >> r) * m
    return h ^ h >> r


def rle(data: bytes) -> bytes:
    """Run lengths: a byte 128 + n - 3 and the byte for n = 3..130 equal ones, a byte n - 1 and n literals else."""
    out, literal, i = bytearray(), bytearray(), 0

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while i < len(data):
        n = 1
        while n < 130 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n >= 3:
            flush()
            out += bytes((125 + n, data[i]))
        else:
            literal += data[i : i + n]
        i += n
    flush()
    return bytes(out)


def unrle(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n, i = data[i], i + 1
        size = 1 if n >= 128 else n + 1
        if i + size > len(data):
            raise ValueError("cut off")
        out += data[i : i + 1] * (n - 125) if n >= 128 else data[i : i + size]
        i += size
    return bytes(out)


def _udf(f, kind: str):
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or x is pd.NA else f(x))

    each.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, kind)


def _many(f, kind: str = "long"):
    """A pandas UDF from a function over a whole batch of byte strings without nulls."""

    def each(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype=object, index=x.index)
        has = x.notna()
        if has.any():
            got = f([bytes(v) for v in x[has]])
            out[has] = got.astype(np.int64).tolist() if isinstance(got, np.ndarray) else got
        return out

    each.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, kind)


def _bytewise(step, start: int, dtype, signed: bool = False):
    """A hash that takes one byte of every text of a batch at a time."""

    def run(data: list[bytes]) -> np.ndarray:
        words, n = _words(data, 1)
        if signed:
            words = words.astype(np.uint8).view(np.int8).astype(np.int64).view(np.uint64)
        h = np.full(len(data), start, np.uint64)
        for i in range(int(n.max(initial=0))):
            h = np.where(i < n, step(h, words[:, i]).astype(dtype).astype(np.uint64), h)
        return h

    return run


def fixed_col(n: Column, bits: int = 64) -> Column:
    """Little-endian bytes of a number."""
    digits = F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(bits // 4))
    return F.unhex(F.regexp_replace(digits, "(..)" * (bits // 8), "".join(f"${i}" for i in range(bits // 8, 0, -1))))


def read_fixed_col(data: Column, bits: int = 64) -> Column:
    """The number of the first bytes (64 bits: as a signed long); null if there are too few."""
    digits = F.regexp_replace(F.hex(F.substring(data, 1, bits // 8)), "(..)" * (bits // 8), "".join(f"${i}" for i in range(bits // 8, 0, -1)))
    high, low = (F.conv(F.substring(digits, a, 8), 16, 10).cast("long") for a in (1, bits // 4 - 7))
    value = low if bits == 32 else F.shiftleft(high, 32).bitwiseOR(low)
    return F.when(F.octet_length(data) >= bits // 8, value)


def varint_size(n: Column) -> Column:
    """How many bytes the varint of a number has."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def varint_col(n: Column) -> Column:
    """The varint of a number (negative ones count as unsigned)."""
    part = lambda i: F.call_function("shiftrightunsigned", n.cast("long"), i * 7).bitwiseAND(F.lit(127))
    last = varint_size(n.cast("long")) - 1
    digits = F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(part(i) + F.when(i < last, 128).otherwise(0)), 2, "0"))
    return F.unhex(F.array_join(digits, ""))


def read_varint_col(data: Column) -> Column:
    """The number of the varint that the bytes begin with; null if it is cut off or too long."""
    digits = F.regexp_extract(F.hex(data), "^(?:[89A-F].){0,9}[0-7].", 0)
    at = F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127))
    value = F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", byte(i), i * 7)))
    return F.when(F.length(digits) > 0, value)


def length_prefixed_col(data: Column) -> Column:
    return F.concat(varint_col(F.octet_length(data)), data)


def internal_key_col(key: Column, seq: Column, op: Column) -> Column:
    """The key and eight bytes of its sequence and operation."""
    return F.concat(key.cast("binary"), fixed_col(tag_col(seq, op)))


def tag_col(seq: Column, op: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 8) + op


def read_tag_col(tag: Column) -> tuple[Column, Column]:
    """Sequence and operation of a tag."""
    return F.shiftright(tag, 8), tag.bitwiseAND(255).cast("int")


def read_internal_key_col(data: Column) -> Column:
    """struct<key, seq, op>; null if there are fewer than eight bytes."""
    n = F.octet_length(data)
    seq, op = read_tag_col(read_fixed_col(F.substring(data, n - 7, F.lit(8))))
    return F.when(n >= 8, F.struct(F.substring(data, F.lit(1), n - 8).alias("key"), seq.alias("seq"), op.alias("op")))


def murmur3_col(data: Column, seed: int = 0) -> Column:
    return _many(lambda x: murmur3_many(x, seed))(data)


def murmur3_128_col(data: Column, seed: int = 0) -> Column:
    """The 32 hexadecimal digits of both halves."""
    return _udf(lambda x: "%016x%016x" % murmur3_128(bytes(x), seed), "string")(data)


def hash32_col(data: Column, seed: int = 0) -> Column:
    return _many(lambda x: hash32_many(x, seed))(data)


def hash64_col(data: Column, seed: int = 0) -> Column:
    return _many(lambda x: hash64_many(x, [seed] * len(x)))(data)


def city32_col(data: Column) -> Column:
    return _many(lambda x: np.where([len(v) <= 4 for v in x], hash32_many(x), _rounds(x, np.array([len(v) for v in x], np.uint64))))(data)


def city64_col(data: Column) -> Column:
    return _many(lambda x: hash64_many(x, [0 if len(v) <= 8 else len(v) for v in x]))(data)


def fnv1a_col(data: Column, bits: int = 32, signed: bool = False) -> Column:
    start, prime = (0x811C9DC5, np.uint64(0x01000193)) if bits == 32 else (0xCBF29CE484222325, np.uint64(0x100000001B3))
    return _many(_bytewise(lambda h, b: (h ^ b) * prime, start, np.uint32 if bits == 32 else np.uint64, signed))(data)


def slice_hash_col(data: Column, signed: bool = False) -> Column:
    return _many(_bytewise(lambda h, b: h * np.uint64(31) + b, 0, np.uint64, signed))(data)


def crc_mask_col(crc: Column) -> Column:
    low = lambda c: c.bitwiseAND(F.lit(_M32))
    return low(F.shiftright(crc, 15).bitwiseOR(low(F.shiftleft(crc, 17))) + 0xA282EAD8)


def crc_unmask_col(masked: Column) -> Column:
    low = lambda c: c.bitwiseAND(F.lit(_M32))
    x = low(masked - 0xA282EAD8)
    return F.shiftright(x, 17).bitwiseOR(low(F.shiftleft(x, 15)))


def rle_col(data: Column) -> Column:
    return _udf(lambda x: rle(bytes(x)), "binary")(data)


def unrle_col(data: Column) -> Column:
    return _udf(lambda x: unrle(bytes(x)), "binary")(data)
