"""Merge-on-read: newest visible version per key, and its relatives.

Every function is DataFrame -> DataFrame.  The rank filter is planned as a
WindowGroupLimit on both sides of the exchange, so each task ships at most one
row per key however often a key was written.  Version filters (as-of,
visibility) come before the merge; value filters must come after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.plans.envelope import DELETE

IDENTITY = ("cf", "key")


def newest(c: DataFrame, by: Sequence[str] = IDENTITY) -> DataFrame:
    """The newest record per key, tombstones included."""
    w = Window.partitionBy(*by).orderBy(F.desc("seq"), F.desc("op_idx"))
    return c.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def latest(c: DataFrame, by: Sequence[str] = IDENTITY) -> DataFrame:
    """Live state: the newest record per key, with deleted keys hidden."""
    return newest(c, by).filter(F.col("op") != DELETE)


def as_of(c: DataFrame, seq: int, by: Sequence[str] = IDENTITY) -> DataFrame:
    """State at a snapshot; snapshot 0 is empty."""
    return latest(c.filter(F.col("seq") <= seq), by)


def overlay(*layers: DataFrame, by: Sequence[str] = IDENTITY) -> DataFrame:
    """Live state of several change sources together."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return latest(out, by)


def read_committed(state: Column, txn: Column, me: int | None = None) -> Column:
    """Committed records, and own ones unless aborted."""
    own = F.lit(False) if me is None else (txn == me) & (state != "aborted")
    return (state == "committed") | own


def repeatable_read(state: Column, txn: Column, up_limit: int, active: Sequence[int], me: int | None = None) -> Column:
    """Records whose creator had committed when the view was taken."""
    own = F.lit(False) if me is None else (txn == me) & (state != "aborted")
    seen = (state == "committed") & (txn < up_limit)
    if active:
        seen = seen & ~txn.isin(list(active))
    return own | seen


def _in_pieces(c: DataFrame, at: str, pieces: int) -> DataFrame:
    """Adds ``_piece``: in which of some ranges of sequences a row lies, so that one key's versions spread over tasks."""
    share = [i / pieces for i in range(1, pieces)]
    bounds = sorted(set(c.agg(F.percentile_approx(at, share, 100 * pieces).alias("q")).first()["q"] or [])) if share else []
    known = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    return c.withColumn("_piece", F.size(F.filter(known, lambda b: b <= F.col(at))))


def intervals(c: DataFrame, by: Sequence[str] = IDENTITY, pieces: int = 1) -> DataFrame:
    """Each version with the sequence at which the next one replaces it.

    With ``pieces`` the versions of one key are ordered range by range of their
    sequences, and only the first sequence of each range goes to the one before.
    """
    if pieces <= 1:
        return c.withColumn("next_seq", F.lead("seq").over(Window.partitionBy(*by).orderBy("seq", "op_idx")))
    d = _in_pieces(c, "seq", pieces)
    inside = Window.partitionBy(*by, "_piece").orderBy("seq", "op_idx")
    d = d.withColumn("next_seq", F.lead("seq").over(inside))
    firsts = d.groupBy(*by, "_piece").agg(F.min("seq").alias("_first"))
    firsts = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*by).orderBy("_piece"))).drop("_first")
    return d.join(firsts, [*by, "_piece"], "left").withColumn("next_seq", F.coalesce("next_seq", "_after")).drop("_piece", "_after")


def newest_k(c: DataFrame, k: int, by: Sequence[str] = IDENTITY) -> DataFrame:
    """The ``k`` newest records per key, tombstones included."""
    w = Window.partitionBy(*by).orderBy(F.desc("seq"), F.desc("op_idx"))
    return c.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def history(c: DataFrame, key: object) -> DataFrame:
    """All versions of one key."""
    return c.filter(F.col("key") == F.lit(key)).orderBy("seq", "op_idx")


def retain(c: DataFrame, oldest: int, bottom: bool = False, by: Sequence[str] = IDENTITY) -> DataFrame:
    """Versions a compaction keeps so that every as-of read at or above ``oldest`` is unchanged.

    Kept are all versions above ``oldest`` and the newest at or below it;
    on the bottom level that one goes too when it is a tombstone.
    """
    old = newest(c.filter(F.col("seq") <= oldest), by)
    if bottom:
        old = old.filter(F.col("op") != DELETE)
    return c.filter(F.col("seq") > oldest).unionByName(old)


def collect_garbage(c: DataFrame, state: str = "state", flushed: str = "flushed", by: Sequence[str] = IDENTITY) -> DataFrame:
    """Drop aborted versions; keep active, unflushed and the newest committed.

    Only the newest committed version of a key is looked for among its versions,
    with a group limit before the shuffle; all others are kept or dropped row by row.
    """
    stays = (F.col(state) == "active") | ((F.col(state) != "aborted") & ~F.col(flushed))
    last = newest(c.filter(F.col(state) == "committed"), by).filter(F.col(flushed))
    return c.filter(stays).unionByName(last)


def unflushed(c: DataFrame, most: int | None = None, state: str = "state", flushed: str = "flushed", by: Sequence[str] = IDENTITY) -> DataFrame:
    """Committed versions that no data file holds yet; with ``most``, those of whole keys, in key order, until that many are reached."""
    todo = c.filter((F.col(state) == "committed") & ~F.col(flushed))
    if most is None:
        return todo
    # A key is taken while fewer than ``most`` versions stand before it, so the first ``most`` keys hold all that are.
    keys = todo.groupBy(*by).agg(F.count("*").alias("_n")).orderBy(*by).limit(most)
    ahead = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    taken = keys.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).filter(F.col("_ahead") < most)
    return todo.join(taken.select(*by), list(by), "left_semi")


def mark_flushed(c: DataFrame, written: DataFrame, flushed: str = "flushed", by: Sequence[str] = IDENTITY) -> DataFrame:
    """The versions with ``flushed`` set for those whose (key, seq) is among ``written``."""
    done = written.select(*by, "seq").distinct().withColumn("_done", F.lit(True))
    return c.join(done, [*by, "seq"], "left").withColumn(flushed, F.col(flushed) | F.coalesce("_done", F.lit(False))).select(*c.columns)


def conflicts(written: DataFrame, read: DataFrame, since: int, by: Sequence[str] = IDENTITY) -> DataFrame:
    """Keys of ``read`` with a version newer than ``since``."""
    newer = written.filter(F.col("seq") > since).groupBy(*by).agg(F.max("seq").alias("seq"))
    return newer.join(read.select(*by), list(by), "left_semi")


def as_of_batch(probes: DataFrame, c: DataFrame, by: Sequence[str] = IDENTITY, pieces: int = 8) -> DataFrame:
    """Answer many (probe_id, key, at_seq) lookups at once; misses and deletes give null.

    Probes and versions are one sequence in order, along which the last version
    is carried: no probe meets more than one version.  A key's sequence is cut
    into ranges that are walked apart; each begins with the newest version of
    those before it, found by a maximum with partial sums.
    """
    version = F.struct("seq", "op", "value")
    v = c.select(*by, F.col("seq").alias("_at"), F.lit(0).alias("_probe"), "op_idx", F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), version.alias("_v"))
    p = probes.select(*by, F.col("at_seq").cast("long").alias("_at"), F.lit(1).alias("_probe"), F.lit(0).cast("long").alias("op_idx"), "probe_id", F.lit(None).cast(v.schema["_v"].dataType).alias("_v"))
    # Keys that nobody asks for go before anything is ordered.
    d = _in_pieces(v.join(probes.select(*by).distinct(), list(by), "left_semi").unionByName(p), "_at", pieces)
    inside = Window.partitionBy(*by, "_piece").orderBy("_at", "_probe", "op_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_hit", F.last("_v", ignorenulls=True).over(inside))
    ends = d.groupBy(*by, "_piece").agg(F.max(F.when(F.col("_probe") == 0, F.struct("_at", "op_idx", "_v"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_piece", F.last("_end", ignorenulls=True).over(before).alias("_before"))
    hit = d.filter("_probe = 1").join(ends, [*by, "_piece"], "left")
    found = F.coalesce(F.col("_hit"), F.col("_before._v"))
    live = hit.withColumn("_f", found).filter(F.col("_f.op") != DELETE).select("probe_id", F.col("_f.seq").alias("seq"), F.col("_f.value").alias("value"))
    return probes.join(live, "probe_id", "left")


def diff(before: DataFrame, after: DataFrame, by: Sequence[str] = IDENTITY) -> DataFrame:
    """Keys that differ between two states: added, removed or changed."""
    a = before.select(*by, F.col("value").alias("old"), F.col("seq").alias("old_seq"))
    b = after.select(*by, F.col("value").alias("new"), F.col("seq").alias("new_seq"))
    kind = F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed").otherwise("changed")
    return a.join(b, list(by), "full_outer").filter(~F.col("old_seq").eqNullSafe(F.col("new_seq"))).withColumn("kind", kind)
