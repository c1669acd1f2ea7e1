"""Aggregations over change records and over file metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.envelope import DELETE, MERGE


def change_stats(c: DataFrame) -> DataFrame:
    """One row: records, distinct keys, deletions, merges, key bounds."""
    return c.agg(
        F.count("*").alias("total"),
        F.countDistinct("key").alias("unique_keys"),
        F.count_if(F.col("op") == DELETE).alias("deletions"),
        F.count_if(F.col("op") == MERGE).alias("merges"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
    )


def file_meta(c: DataFrame, file: Column, key_bytes: Column, value_bytes: Column) -> DataFrame:
    """Per file: entries, deletions, raw sizes, key bounds, sequence bounds."""
    return c.groupBy(file.alias("file")).agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("op") == DELETE).alias("deletions"),
        F.sum(key_bytes).cast("long").alias("raw_key_bytes"),
        F.sum(F.coalesce(value_bytes, F.lit(0))).cast("long").alias("raw_value_bytes"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(
        F.count("*").alias("files"),
        F.sum("bytes").cast("long").alias("total_bytes"),
        F.floor(F.avg("bytes")).cast("long").alias("mean_bytes"),
        F.concat_ws("-", F.min("min_key"), F.max("max_key")).alias("key_range"),
    )


def approximate_sizes(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of the files that overlap each range.

    Both sides are catalog metadata (ranges asked for, live files), not rows.
    """
    hit = (F.col("min_key") < F.col("range_end")) & (F.col("max_key") >= F.col("range_start"))
    return ranges.join(files.select("file", "bytes", "min_key", "max_key"), hit, "left").groupBy("range_id").agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.count("file").alias("files"))


def bloom_bits(n: Column, fpr: float) -> Column:
    """m = -n ln p / (ln 2)^2, rounded up."""
    return F.ceil(-n * F.log(F.lit(fpr)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).cast("long")


def bloom_hashes(bits: Column, n: Column) -> Column:
    """k = m/n ln 2, rounded, at least one."""
    return F.greatest(F.lit(1), F.floor(bits / n * F.log(F.lit(2.0)) + 0.5)).cast("long")


def bloom_rate(bits: Column, n: Column, k: Column) -> Column:
    """(1 - e^(-kn/m))^k"""
    return F.pow(1 - F.exp(-k * n / bits), k)


def estimate_file_bytes(payload: Column, entries: Column) -> Column:
    return payload + entries * 20 + 1024


def key_in_range(key: Column, min_key: Column, max_key: Column) -> Column:
    """Whether a file may hold a key; both bounds belong to it."""
    return (key >= min_key) & (key <= max_key)


def overlaps(min_key: Column, max_key: Column, other_min: Column, other_max: Column) -> Column:
    return (min_key <= other_max) & (other_min <= max_key)


def files_in_range(files: DataFrame, first: object = None, last: object = None, level: int | None = None) -> DataFrame:
    """Files that may hold keys from first to last, both included; None is open."""
    out = files
    if first is not None:
        out = out.filter(F.col("max_key") >= F.lit(first))
    if last is not None:
        out = out.filter(F.col("min_key") <= F.lit(last))
    return out if level is None else out.filter(F.col("level") == level)
