"""The change-record envelope and the ordering expressions of a keyspace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE, MERGE = 1, 2, 3

CHANGE = T.StructType(
    [
        T.StructField("cf", T.StringType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op_idx", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("txn_id", T.LongType(), True),
    ]
)

#: Names that survive a reopen; any other name is an error, never a silent fallback.
ORDERINGS = ["bytewise", "reverse_bytewise", "numeric32", "numeric64", "prefix"]
_CUSTOM: dict[str, tuple[Callable[[Column], Column], Callable[[bytes], bytes]]] = {}


def register_ordering(name: str, column: Callable[[Column], Column], function: Callable[[bytes], bytes]) -> None:
    """A keyspace ordering of one's own: the same sort key as a column and as a function, compared bytewise.

    Register it before a store that uses it is opened.
    """
    if name in ORDERINGS and name not in _CUSTOM:
        raise ValueError(f"{name!r} is built in")
    _CUSTOM[name] = (column, function)
    if name not in ORDERINGS:
        ORDERINGS.append(name)


_HEADS = {"numeric32": 4, "numeric64": 8}


def sort_key(name: str, key: Column, prefix: int = 0) -> Column:
    """A column whose bytewise order is the keyspace's (for reverse_bytewise the opposite).

    numeric orders compare an unsigned little-endian head and then the rest;
    keys shorter than the head sort first, bytewise.
    """
    if name in ("bytewise", "reverse_bytewise"):
        return key
    if name in _HEADS:
        n = _HEADS[name]
        swapped = F.unhex(F.regexp_replace(F.hex(F.substring(key, 1, n)), "(..)" * n, "".join(f"${i}" for i in range(n, 0, -1))))
        return F.when(F.octet_length(key) >= n, F.concat(F.lit(b"\x01"), swapped, F.substring(key, n + 1, (1 << 31) - 1 - n))).otherwise(F.concat(F.lit(b"\x00"), key))
    if name == "prefix":
        return F.substring(key, 1, prefix)
    if name in _CUSTOM:
        return _CUSTOM[name][0](key)
    raise ValueError(f"unknown ordering {name!r}")


def sort_key_of(name: str, key: bytes, prefix: int = 0) -> bytes:
    """The same of one key."""
    if name in ("bytewise", "reverse_bytewise"):
        return key
    if name in _HEADS:
        n = _HEADS[name]
        return b"\x01" + key[:n][::-1] + key[n:] if len(key) >= n else b"\x00" + key
    if name == "prefix":
        return key[:prefix]
    if name in _CUSTOM:
        return _CUSTOM[name][1](key)
    raise ValueError(f"unknown ordering {name!r}")


def sort_columns(name: str, key: Column, prefix: int = 0, reverse: bool = False) -> list[Column]:
    """Scan order of a keyspace as Catalyst sort expressions."""
    column = sort_key(name, key, prefix)
    return [column.desc() if (name == "reverse_bytewise") != reverse else column.asc()]


def within(name: str, key: Column, start: object = None, end: object = None, prefix: int = 0) -> Column:
    """start <= key < end in the order of the keyspace, where None is open."""
    cond, column = F.lit(True), sort_key(name, key, prefix)
    of = lambda x: F.lit(sort_key_of(name, x, prefix) if isinstance(x, bytes) else x)
    if start is not None:
        cond = cond & ((column <= of(start)) if name == "reverse_bytewise" else (column >= of(start)))
    if end is not None:
        cond = cond & ((column > of(end)) if name == "reverse_bytewise" else (column < of(end)))
    return cond


def identity(name: str, key: Column, prefix: int = 0) -> Column:
    """The expression two keys must share to be the same key under an ordering."""
    return sort_key(name, key, prefix) if name == "prefix" or name in _CUSTOM else key


def changes(df: DataFrame, key: Column, seq: Column, op: Column, value: Column, cf: Column | str = "default", txn: Column | None = None, op_idx: Column | None = None) -> DataFrame:
    """View any DataFrame as a change log; column types are left as they are."""
    return df.select(
        (F.lit(cf) if isinstance(cf, str) else cf).alias("cf"),
        key.alias("key"),
        seq.cast("long").alias("seq"),
        (F.lit(0) if op_idx is None else op_idx).cast("long").alias("op_idx"),
        op.cast("tinyint").alias("op"),
        value.alias("value"),
        (F.lit(None) if txn is None else txn).cast("long").alias("txn_id"),
    )


def successor(prefix: bytes) -> bytes | None:
    """Smallest byte string above every string with this prefix; None when unbounded."""
    trimmed = prefix.rstrip(b"\xff")
    return trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None


def shortest_separator(start: bytes, limit: bytes) -> bytes:
    """A short string s with start <= s < limit."""
    common = next((i for i, (a, b) in enumerate(zip(start, limit, strict=False)) if a != b), None)
    if common is not None and start[common] + 1 < limit[common]:
        return start[:common] + bytes([start[common] + 1])
    return start
