"""Lookups and ordered scans over a merged state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.envelope import sort_columns, sort_key, sort_key_of, successor, within


def get(state: DataFrame, key: object) -> DataFrame:
    """Zero or one row; the key predicate reaches the scan through the merge."""
    return state.filter(F.col("key") == F.lit(key))


def multi_get(keys: DataFrame, state: DataFrame, on: str = "key") -> DataFrame:
    """One row per probe (pos, key), in any order; misses have status NotFound.

    A plain equi-join: Spark broadcasts whichever side it measures as small.
    """
    found = state.select(on, F.col("value"), F.lit(True).alias("_hit"))
    out = keys.join(found, on, "left")
    return out.select(*keys.columns, "value", F.when(F.col("_hit"), "OK").otherwise("NotFound").alias("status"))


def exists(keys: DataFrame, state: DataFrame, on: str = "key") -> DataFrame:
    return keys.join(state.select(on), on, "left_semi")


def between(key: Column, start: object = None, end: object = None) -> Column:
    """start <= key < end, where None is open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (key >= F.lit(start))
    if end is not None:
        cond = cond & (key < F.lit(end))
    return cond


def scan(state: DataFrame, start: object = None, end: object = None, limit: int = 0, reverse: bool = False, ordering: str = "bytewise", prefix: int = 0) -> DataFrame:
    """Ordered scan of start <= key < end, both in the keyspace's order.  With a limit it is planned as TakeOrderedAndProject."""
    out = state.filter(within(ordering, F.col("key"), start, end, prefix)).orderBy(*sort_columns(ordering, F.col("key"), prefix, reverse))
    return out.limit(limit) if limit else out


def seek(state: DataFrame, target: object, ordering: str = "bytewise", prefix: int = 0) -> DataFrame:
    """The first key at or behind the target in the keyspace's order."""
    return scan(state, start=target, limit=1, ordering=ordering, prefix=prefix)


def seek_for_prev(state: DataFrame, target: object, ordering: str = "bytewise", prefix: int = 0) -> DataFrame:
    """The last key at or before the target."""
    column, at = sort_key(ordering, F.col("key"), prefix), F.lit(sort_key_of(ordering, target, prefix) if isinstance(target, bytes) else target)
    before = column >= at if ordering == "reverse_bytewise" else column <= at
    return state.filter(before).orderBy(*sort_columns(ordering, F.col("key"), prefix, reverse=True)).limit(1)


def iterator_stats(entries: DataFrame) -> DataFrame:
    """One row: entries, key bytes and value bytes of a scan."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(F.col(c).cast("binary"))), F.lit(0)).alias(f"{c}_bytes")
    return entries.agg(F.count("*").alias("entries"), size("key"), size("value"))


def same_entries(a: DataFrame, b: DataFrame) -> bool:
    """Whether two scans hold the same entries, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def prefix_scan(state: DataFrame, prefix: bytes | str, limit: int = 0) -> DataFrame:
    """All keys with a prefix, as a range predicate that min/max statistics can prune."""
    if isinstance(prefix, str):
        end = successor(prefix.encode())
        try:
            return scan(state, prefix, None if end is None else end.decode(), limit)
        except UnicodeDecodeError:
            out = state.filter(F.col("key").startswith(prefix)).orderBy("key")
            return out.limit(limit) if limit else out
    return scan(state, prefix, successor(prefix), limit)
