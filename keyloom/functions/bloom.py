"""Bloom filters as tables of 64-bit words: built by an aggregation, tested by a join.

One filter for each group (a keyspace, a file); k positions of a key come from
two hashes of it.  Files written by the store have Parquet's own Bloom filters,
which Spark tests at the scan; these serve what isn't a Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positions(key: Column, bits: Column, hashes: Column) -> Column:
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))
    # Unsigned 31-bit parts, so that sums stay in a long.
    x, y = F.shiftrightunsigned(a, 33), F.shiftrightunsigned(b, 33)
    return F.transform(F.sequence(F.lit(0).cast("long"), hashes.cast("long") - 1), lambda i: (x + i * y) % bits)


def create(keys: DataFrame, sizes: DataFrame, by: str, key: str = "key") -> DataFrame:
    """(by, word, bits): the filters of keys (by, key) with the given (by, bits, hashes)."""
    d = keys.join(sizes.withColumnRenamed("bits", "_m").withColumnRenamed("hashes", "_k"), by)
    d = d.select(by, F.explode(positions(F.col(key), F.col("_m"), F.col("_k"))).alias("p"))
    return d.groupBy(by, F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))


def test(probes: DataFrame, filters: DataFrame, sizes: DataFrame, by: str, key: str = "key") -> DataFrame:
    """(by, key, maybe) for each distinct probe; False means that the key isn't in the group."""
    d = probes.select(by, key).distinct().join(sizes.withColumnRenamed("bits", "_m").withColumnRenamed("hashes", "_k"), by)
    d = d.select(by, key, F.explode(positions(F.col(key), F.col("_m"), F.col("_k"))).alias("p")).withColumn("word", F.floor(F.col("p") / 64))
    hit = F.call_function("shiftright", F.coalesce("bits", F.lit(0).cast("long")), (F.col("p") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return d.join(filters, [by, "word"], "left").groupBy(by, key).agg(F.bool_and(hit).alias("maybe"))
