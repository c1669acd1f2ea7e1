"""Registered queries that write a store from the driver tables and read it back, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import codec
from keyloom.plans.queries import C, _latest, _register, table
from keyloom.sources.paths import new_path
from keyloom.sources.store import Conflict, Store, open_store


def _key(c: Column) -> Column:
    return F.encode(F.lpad(c.cast("string"), 12, "0"), "UTF-8")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(_key(F.col("o_orderkey")).alias("key"), F.encode("o_orderpriority", "UTF-8").alias("value"), "o_orderstatus")


def _read(df: DataFrame) -> DataFrame:
    return df.select(F.decode("key", "UTF-8").cast("long").alias("k"), F.decode("value", "UTF-8").alias("v"))


def _new(spark: SparkSession, **options) -> Store:
    return open_store(spark, new_path(spark, "store"), **options)


def _written(spark: SparkSession, sf: str) -> tuple[Store, int]:
    """All orders put, then those of status F deleted; and the version between."""
    s, o = _new(spark), _orders(spark, sf)
    before = s.put_all(o.select("key", "value"))
    s.delete_all(o.filter("o_orderstatus = 'F'").select("key"))
    return s, before


LIVE = "SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderstatus <> 'F'"
ALL = "SELECT o_orderkey AS k, o_orderpriority AS v FROM orders"


@_register("store_put_delete_scan", LIVE)
def _(spark, sf):
    return _read(_written(spark, sf)[0].scan())


@_register("store_snapshot_scan", ALL)
def _(spark, sf):
    s, before = _written(spark, sf)
    return _read(s.scan(as_of=before))


@_register("store_reopen_range_scan", f"SELECT * FROM ({LIVE}) WHERE k >= 100 AND k < 9000")
def _(spark, sf):
    s, _ = _written(spark, sf)
    return _read(open_store(spark, s.root, read_only=True).scan(b"%012d" % 100, b"%012d" % 9000))


@_register("store_multi_get", "SELECT p.k, CASE WHEN o.o_orderkey IS NULL THEN 'NotFound' ELSE 'OK' END AS status FROM (SELECT c_custkey * 11 AS k FROM customer) p LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') o ON o.o_orderkey = p.k")
def _(spark, sf):
    s, _ = _written(spark, sf)
    probes = table(spark, sf, "customer").select((F.col("c_custkey") * 11).alias("k"), _key(F.col("c_custkey") * 11).alias("key"))
    return s.multi_get(probes).select("k", "status")


@_register("store_keyspaces", "SELECT c_mktsegment AS cf, c_custkey AS k, c_name AS v FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_mktsegment <> 'BUILDING' OR c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0")
def _(spark, sf):
    """A keyspace for each segment, written in one commit; one is dropped, in one every second key is deleted."""
    c = table(spark, sf, "customer").select(_key(F.col("c_custkey")).alias("key"), F.encode("c_name", "UTF-8").alias("value"), "c_mktsegment", "c_custkey")
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    s = _new(spark, cfs=names)
    s.apply({n: c.filter(F.col("c_mktsegment") == n).select("key", F.lit(1).alias("op"), "value") for n in names})
    s.drop_cf("MACHINERY")
    s.delete_all(c.filter("c_mktsegment = 'BUILDING' AND c_custkey % 2 = 1").select("key"), "BUILDING")
    out = None
    for n in s.list_cfs():
        part = _read(s.scan(cf=n)).select(F.lit(n).alias("cf"), "k", "v")
        out = part if out is None else out.unionByName(part)
    return out


@_register("store_transactions", f"SELECT k, CASE WHEN k = 1 THEN 'mine' ELSE v END AS v FROM ({ALL}) WHERE k <> 2 UNION ALL SELECT 990000000001, 'new'")
def _(spark, sf):
    """One transaction commits, one is rolled back, one loses against the first."""
    s = _new(spark)
    s.put_all(_orders(spark, sf).select("key", "value"))
    late = open_store(spark, s.root).begin()
    late.put(b"%012d" % 1, b"late")
    with s.begin() as t:
        t.put(b"%012d" % 1, b"mine")
        t.delete(b"%012d" % 2)
        t.put(b"990000000001", b"new")
    gone = s.begin()
    gone.put(b"%012d" % 3, b"rolled back")
    gone.rollback()
    try:
        late.commit()
        raise AssertionError("a lost update")
    except Conflict:
        pass
    return _read(s.scan())


@_register("store_repeatable_read", ALL)
def _(spark, sf):
    """What a transaction sees after others deleted rows."""
    s, o = _new(spark), _orders(spark, sf)
    s.put_all(o.select("key", "value"))
    t = open_store(spark, s.root).begin("repeatable_read")
    s.delete_all(o.filter("o_orderstatus = 'F'").select("key"))
    return _read(t.scan())


@_register("store_compaction", f"SELECT *, (SELECT count(*) FROM ({LIVE})) AS entries FROM ({LIVE})")
def _(spark, sf):
    s, _ = _written(spark, sf)
    s.compact(target_rows=4000)
    s.vacuum(0)
    return _read(s.scan()).withColumn("entries", F.lit(s.property("num-entries")).cast("long"))


@_register("store_delete_range", f"SELECT * FROM ({LIVE}) WHERE k < 500 OR k >= 1000")
def _(spark, sf):
    s, _ = _written(spark, sf)
    s.delete_range(b"%012d" % 500, b"%012d" % 1000)
    return _read(s.scan())


@_register("store_last_write_wins", f"{C} SELECT k, v FROM {_latest('c')}")
def _(spark, sf):
    """All events in one commit, ordered by their number."""
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", 2).otherwise(1)
    rows = e.select(_key(F.col("user_id")).alias("key"), op.alias("op"), F.encode("props", "UTF-8").alias("value"), F.col("event_id").alias("op_idx"))
    s = _new(spark)
    s.apply({"default": rows})
    return _read(s.scan())


@_register("store_numeric_keyspace", "SELECT n FROM (SELECT DISTINCT o_orderkey * 37 % 100003 AS n FROM orders) WHERE n >= 255 ORDER BY n LIMIT 200")
def _(spark, sf):
    s = _new(spark)
    s.create_cf("n", ordering="numeric64")
    s.put_all(table(spark, sf, "orders").select(codec.fixed_col(F.col("o_orderkey") * 37 % 100003).alias("key"), F.lit(b"").alias("value")), "n")
    return s.scan((255).to_bytes(8, "little"), limit=200, cf="n").select(codec.read_fixed_col(F.col("key")).alias("n"))


@_register("store_reverse_keyspace", "SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey <= 800 AND o_orderkey > 300 ORDER BY o_orderkey DESC LIMIT 100")
def _(spark, sf):
    s = _new(spark)
    s.create_cf("r", ordering="reverse_bytewise")
    s.put_all(_orders(spark, sf).select("key", "value"), "r")
    return _read(s.scan(b"%012d" % 800, b"%012d" % 300, limit=100, cf="r"))


@_register("store_file_stats", "SELECT count(*) AS entries, count(*) FILTER (o_orderstatus = 'F') AS deleted, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def _(spark, sf):
    f = _written(spark, sf)[0].file_table()
    number = lambda c: F.decode(c, "UTF-8").cast("long")
    return f.agg((F.sum("entries") - F.sum("deletions")).alias("entries"), F.sum("deletions").alias("deleted"), number(F.min("min_key")).alias("first"), number(F.max("max_key")).alias("last"))
