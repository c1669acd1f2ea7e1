"""String functions of keys and the names of the store's files, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_with(key: Column, prefix: str | bytes) -> Column:
    return key.startswith(prefix) if isinstance(prefix, str) else F.startswith(key, F.lit(prefix))


def ends_with(key: Column, suffix: str | bytes) -> Column:
    return key.endswith(suffix) if isinstance(suffix, str) else F.endswith(key, F.lit(suffix))


def substr(key: Column, at: int, n: int | None = None) -> Column:
    """From position ``at``, which counts from 0."""
    return F.substring(key, at + 1, n if n is not None else (1 << 31) - 1)


def find(key: Column, part: str, at: int = 0) -> Column:
    """The first position of a part at or behind ``at``, from 0; -1 if there is none."""
    return F.locate(part, key, at + 1) - 1


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def wal_name(number: Column) -> Column:
    return F.format_string("%06d.wal", number)


def table_name(number: Column) -> Column:
    return F.format_string("%06d.sst", number)


def manifest_name(number: Column) -> Column:
    return F.format_string("MANIFEST-%06d", number)


def file_number(name: Column) -> Column:
    """The number in a file name of these kinds; null for other names."""
    digits = F.regexp_extract(name, r"^(?:MANIFEST-([0-9]+)|([0-9]+)\.(?:wal|sst))$", 0)
    return F.when(F.length(digits) > 0, F.regexp_extract(name, "[0-9]+", 0).cast("long"))
