"""Registered queries over the driver tables, each beside its ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import bloom, codec, slices
from keyloom.operators import merge, read, stats
from keyloom.plans.envelope import changes, identity, register_ordering

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a change log: key user_id, seq event_id + 1, errors are deletes."""
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", 2).otherwise(1)
    return changes(e, F.col("user_id"), F.col("event_id") + 1, op, F.col("props"), txn=F.expr("event_id DIV 10 + 1"))


def event_cf_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", 2).otherwise(1)
    return changes(e, F.col("user_id"), F.col("event_id") + 1, op, F.col("props"), cf=F.col("event_type"))


def order_log(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    op = F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)
    return changes(o, F.col("o_custkey"), F.col("o_orderkey") + 1, op, F.col("o_orderpriority"))


def url_state(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.filter("url IS NOT NULL").select(F.col("url").alias("key"), "page_id")


def with_state(c: DataFrame) -> DataFrame:
    """Simulated transaction outcomes: every 7th aborted, every 11th still open."""
    state = F.when(F.col("txn_id") % 7 == 0, "aborted").when(F.col("txn_id") % 11 == 0, "active").otherwise("committed")
    return c.withColumn("state", state).withColumn("flushed", F.col("seq") < 8000)


C = """WITH c AS (SELECT user_id AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
 event_type AS cf, props AS v, event_id // 10 + 1 AS txn FROM events),
 cs AS (SELECT *, CASE WHEN txn % 7 = 0 THEN 'aborted' WHEN txn % 11 = 0 THEN 'active' ELSE 'committed' END AS state, seq < 8000 AS flushed FROM c)
"""


def _latest(src: str, part: str = "k") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY seq DESC) AS rn FROM {src}) WHERE rn = 1 AND op <> 2)"


def _kv(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("k"), "seq", F.col("value").alias("v"))


@_register("kv_latest_state", f"{C} SELECT k, seq, v FROM {_latest('c')}")
def _(spark, sf):
    return _kv(merge.latest(event_log(spark, sf)))


@_register("kv_snapshot_asof", f"{C} SELECT k, seq, v FROM {_latest('(SELECT * FROM c WHERE seq <= 5000)')}")
def _(spark, sf):
    return _kv(merge.as_of(event_log(spark, sf), 5000))


@_register("kv_point_get", f"{C} SELECT k, seq, v FROM {_latest('c')} WHERE k = 7 OR k = 11")
def _(spark, sf):
    s = merge.latest(event_log(spark, sf))
    return _kv(read.get(s, 7).unionByName(read.get(s, 11)))


@_register("kv_point_get_snapshot", f"{C} SELECT k, seq, v FROM {_latest('(SELECT * FROM c WHERE seq <= 2500)')} WHERE k = 7")
def _(spark, sf):
    return _kv(read.get(merge.as_of(event_log(spark, sf), 2500), 7))

def _probes(spark):
    return spark.range(80).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("key"))


@_register("kv_multi_get", f"{C} SELECT p.pos, p.key, l.v AS value, CASE WHEN l.k IS NULL THEN 'NotFound' ELSE 'OK' END AS status FROM (SELECT r AS pos, r * 3 AS key FROM range(80) t(r)) p LEFT JOIN {_latest('c')} l ON l.k = p.key")
def _(spark, sf):
    return read.multi_get(_probes(spark), merge.latest(event_log(spark, sf)))


@_register("kv_batch_get", f"{C} SELECT p.pos, p.key, coalesce(l.v, '') AS value FROM (SELECT r AS pos, r * 3 AS key FROM range(80) t(r)) p LEFT JOIN {_latest('c')} l ON l.k = p.key")
def _(spark, sf):
    got = read.multi_get(_probes(spark), merge.latest(event_log(spark, sf)))
    return got.select("pos", "key", F.coalesce("value", F.lit("")).alias("value"))


@_register("kv_key_exists", f"{C} SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT k FROM {_latest('c')})")
def _(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return read.exists(cust, merge.latest(event_log(spark, sf))).select(F.col("key").alias("c_custkey"), "c_name")


@_register("kv_full_scan", f"{C} SELECT k, v FROM {_latest('c')} ORDER BY k")
def _(spark, sf):
    return read.scan(merge.latest(event_log(spark, sf))).select(F.col("key").alias("k"), F.col("value").alias("v"))


@_register("kv_range_scan_limit", "SELECT url AS key, page_id FROM pages WHERE url >= 'http://' AND url < 'https://' ORDER BY url LIMIT 20")
def _(spark, sf):
    return read.scan(url_state(spark, sf), "http://", "https://", 20)


@_register("kv_seek", "SELECT url AS key, page_id FROM pages WHERE url >= 'https://m' ORDER BY url LIMIT 1")
def _(spark, sf):
    return read.seek(url_state(spark, sf), "https://m")


@_register("kv_seek_for_prev", "SELECT url AS key, page_id FROM pages WHERE url <= 'https://m' ORDER BY url DESC LIMIT 1")
def _(spark, sf):
    return read.seek_for_prev(url_state(spark, sf), "https://m")


@_register("kv_reverse_scan", "SELECT url AS key, page_id FROM pages ORDER BY url DESC LIMIT 15")
def _(spark, sf):
    return read.scan(url_state(spark, sf), limit=15, reverse=True)


@_register("kv_prefix_scan", "SELECT url AS key, page_id FROM pages WHERE starts_with(url, 'https://m.')")
def _(spark, sf):
    return read.prefix_scan(url_state(spark, sf), "https://m.")


@_register("kv_multi_cf_scan", f"{C} SELECT cf, k, seq, v FROM {_latest('c', 'cf, k')}")
def _(spark, sf):
    return merge.latest(event_cf_log(spark, sf)).select("cf", F.col("key").alias("k"), "seq", F.col("value").alias("v"))


OVER = "(SELECT o_orderkey AS k, 0 AS seq, 1 AS op, o_orderpriority AS v FROM orders UNION ALL SELECT k, seq, op, v FROM c)"


@_register("kv_overlay_merge", f"{C} SELECT k, seq, v FROM {_latest(OVER)}")
def _(spark, sf):
    o = table(spark, sf, "orders")
    base = changes(o, F.col("o_orderkey"), F.lit(0), F.lit(1), F.col("o_orderpriority"))
    return _kv(merge.overlay(base, event_log(spark, sf)))


@_register("kv_rc_visible", f"{C} SELECT k, seq, v FROM {_latest('''(SELECT * FROM cs WHERE state = 'committed')''')}")
def _(spark, sf):
    c = with_state(event_log(spark, sf))
    return _kv(merge.latest(c.filter(merge.read_committed(F.col("state"), F.col("txn_id")))))


@_register("kv_own_writes", f"{C} SELECT k, seq, v FROM {_latest('''(SELECT * FROM cs WHERE state = 'committed' OR (txn = 990 AND state <> 'aborted'))''')}")
def _(spark, sf):
    c = with_state(event_log(spark, sf))
    return _kv(merge.latest(c.filter(merge.read_committed(F.col("state"), F.col("txn_id"), 990))))


@_register("kv_rr_visible", f"{C} SELECT k, seq, v FROM {_latest('''(SELECT * FROM cs WHERE state = 'committed' AND txn < 500 AND txn NOT IN (490, 495, 498))''')}")
def _(spark, sf):
    c = with_state(event_log(spark, sf))
    return _kv(merge.latest(c.filter(merge.repeatable_read(F.col("state"), F.col("txn_id"), 500, [490, 495, 498]))))


@_register("kv_version_intervals", f"{C} SELECT k, seq, lead(seq) OVER (PARTITION BY k ORDER BY seq) AS next_seq FROM c")
def _(spark, sf):
    return merge.intervals(event_log(spark, sf)).select(F.col("key").alias("k"), "seq", "next_seq")


@_register("kv_history", f"{C} SELECT k, seq, op, v FROM c WHERE k = 7")
def _(spark, sf):
    return merge.history(event_log(spark, sf), 7).select(F.col("key").alias("k"), "seq", F.col("op").cast("int").alias("op"), F.col("value").alias("v"))


KEEP = "(SELECT *, row_number() OVER (PARTITION BY k, seq > 5000 ORDER BY seq DESC) AS rk FROM c)"


@_register("kv_retention", f"{C} SELECT k, seq, v FROM {KEEP} WHERE seq > 5000 OR rk = 1")
def _(spark, sf):
    return _kv(merge.retain(event_log(spark, sf), 5000))


@_register("kv_compaction_bottom", f"{C} SELECT k, seq, v FROM {KEEP} WHERE seq > 5000 OR (rk = 1 AND op <> 2)")
def _(spark, sf):
    return _kv(merge.retain(event_log(spark, sf), 5000, bottom=True))


@_register("kv_gc_keep", f"{C} SELECT k, seq, state FROM (SELECT *, row_number() OVER (PARTITION BY k, state ORDER BY seq DESC) AS rk FROM cs WHERE state <> 'aborted') WHERE state = 'active' OR NOT flushed OR rk = 1")
def _(spark, sf):
    return merge.collect_garbage(with_state(event_log(spark, sf))).select(F.col("key").alias("k"), "seq", "state")


@_register("kv_unflushed_pick", f"{C} SELECT k, seq, v FROM cs WHERE state = 'committed' AND NOT flushed")
def _(spark, sf):
    return _kv(merge.unflushed(with_state(event_log(spark, sf))))


@_register("kv_conflict_keys", f"{C} SELECT k, max(seq) AS seq FROM c WHERE txn BETWEEN 106 AND 115 AND k IN (SELECT k FROM c WHERE txn BETWEEN 100 AND 105) GROUP BY k")
def _(spark, sf):
    c = event_log(spark, sf)
    mine = c.filter(F.col("txn_id").between(100, 105))
    return merge.conflicts(c.filter(F.col("txn_id") <= 115), mine, 1050).select(F.col("key").alias("k"), "seq")


@_register("kv_asof_batch", f"""{C}, p AS (SELECT r AS probe_id, r AS k, (r * 997) % 10000 AS at_seq FROM range(80) t(r)),
 j AS (SELECT p.probe_id, c.*, row_number() OVER (PARTITION BY p.probe_id ORDER BY c.seq DESC) AS rn FROM p JOIN c ON c.k = p.k AND c.seq <= p.at_seq)
 SELECT p.probe_id, p.k, p.at_seq, j.seq, j.v FROM p LEFT JOIN j ON j.probe_id = p.probe_id AND j.rn = 1 AND j.op <> 2""")
def _(spark, sf):
    p = spark.range(80).select(F.col("id").alias("probe_id"), F.lit("default").alias("cf"), F.col("id").alias("key"), ((F.col("id") * 997) % 10000).alias("at_seq"))
    return merge.as_of_batch(p, event_log(spark, sf)).select("probe_id", F.col("key").alias("k"), "at_seq", "seq", F.col("value").alias("v"))


@_register("kv_snapshot_diff", f"""{C}, a AS {_latest('(SELECT * FROM c WHERE seq <= 5000)')}, b AS {_latest('c')}
 SELECT coalesce(a.k, b.k) AS k, a.seq AS old_seq, b.seq AS new_seq, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS kind
 FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.seq IS DISTINCT FROM b.seq""")
def _(spark, sf):
    c = event_log(spark, sf)
    return merge.diff(merge.as_of(c, 5000), merge.latest(c)).select(F.col("key").alias("k"), "old_seq", "new_seq", "kind")


META = """SELECT seq // 1000 AS file, count(*) AS entries, count(*) FILTER (op = 2) AS deletions, CAST(sum(length(CAST(k AS VARCHAR))) AS BIGINT) AS raw_key_bytes,
 CAST(sum(coalesce(strlen(v), 0)) AS BIGINT) AS raw_value_bytes, min(k) AS min_key, max(k) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq FROM c GROUP BY 1"""


def _files(spark, sf):
    c = event_log(spark, sf)
    return stats.file_meta(c, F.expr("seq DIV 1000"), F.octet_length(F.col("key").cast("string")), F.octet_length("value"))


@_register("kv_sst_meta", f"{C} {META}")
def _(spark, sf):
    return _files(spark, sf)


@_register("kv_level_stats", f"""{C}, f AS ({META}) SELECT least(file, 3) AS level, count(*) AS files, CAST(sum(raw_value_bytes) AS BIGINT) AS total_bytes,
 CAST(sum(raw_value_bytes) // count(*) AS BIGINT) AS mean_bytes, min(min_key) || '-' || max(max_key) AS key_range FROM f GROUP BY 1""")
def _(spark, sf):
    f = _files(spark, sf).select(F.least("file", F.lit(3)).alias("level"), F.col("raw_value_bytes").alias("bytes"), "min_key", "max_key")
    return stats.level_stats(f)


@_register("kv_approx_size", f"""{C}, f AS ({META}), r(range_id, range_start, range_end) AS (VALUES (0, 0, 10), (1, 10, 100), (2, 100, 1000), (3, 100000, 200000))
 SELECT range_id, CAST(coalesce(sum(raw_value_bytes), 0) AS BIGINT) AS bytes, count(file) AS files FROM r LEFT JOIN f ON min_key < range_end AND max_key >= range_start GROUP BY range_id""")
def _(spark, sf):
    r = spark.createDataFrame([(0, 0, 10), (1, 10, 100), (2, 100, 1000), (3, 100000, 200000)], "range_id int, range_start long, range_end long")
    return stats.approximate_sizes(r, _files(spark, sf).withColumnRenamed("raw_value_bytes", "bytes"))


@_register("kv_memtable_stats", f"{C} SELECT count(*) AS total, count(DISTINCT k) AS unique_keys, count(*) FILTER (op = 2) AS deletions, count(*) FILTER (op = 3) AS merges, min(k) AS min_key, max(k) AS max_key FROM c")
def _(spark, sf):
    return stats.change_stats(event_log(spark, sf))


@_register("kv_internal_key", f"{C} SELECT seq, seq * 256 + op AS tag, (seq * 256 + op) >> 8 AS seq_back, CAST((seq * 256 + op) & 255 AS INTEGER) AS op_back FROM c")
def _(spark, sf):
    tag = codec.tag_col(F.col("seq"), F.col("op"))
    seq, op = codec.read_tag_col(tag)
    return event_log(spark, sf).select("seq", tag.alias("tag"), seq.alias("seq_back"), op.alias("op_back"))


@_register("kv_varint_len", f"{C} SELECT seq, CAST(greatest(1, ceil(length(bin(seq)) / 7.0)) AS INTEGER) AS n FROM c")
def _(spark, sf):
    return event_log(spark, sf).select("seq", codec.varint_size(F.col("seq")).alias("n"))


@_register("kv_bloom_sizing", f"""{C}, n AS (SELECT cf, count(DISTINCT k) AS n FROM c GROUP BY cf), b AS (SELECT cf, n, CAST(ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits FROM n)
 SELECT cf, n, bits, CAST(greatest(1, floor(CAST(bits AS DOUBLE) / n * ln(2) + 0.5)) AS BIGINT) AS hashes FROM b""")
def _(spark, sf):
    n = event_cf_log(spark, sf).groupBy("cf").agg(F.countDistinct("key").alias("n"))
    return n.withColumn("bits", stats.bloom_bits(F.col("n"), 0.01)).withColumn("hashes", stats.bloom_hashes(F.col("bits"), F.col("n")))


@_register("kv_prefix_comparator", "SELECT substring(url, 1, 10) AS prefix, count(*) AS n, min(url) AS first_key FROM pages WHERE url IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return url_state(spark, sf).groupBy(identity("prefix", F.col("key"), 10).alias("prefix")).agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@_register("kv_order_chain", f"SELECT k, seq, v FROM {_latest('''(SELECT o_custkey AS k, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS op, o_orderpriority AS v FROM orders)''')}")
def _(spark, sf):
    return _kv(merge.latest(order_log(spark, sf)))


@_register("kv_composite_scan", "SELECT conv_id, turn, role FROM conversations WHERE conv_id >= 10 AND conv_id < 40")
def _(spark, sf):
    t = table(spark, sf, "conversations")
    return t.filter(read.between(F.col("conv_id"), 10, 40)).orderBy("conv_id", "turn").select("conv_id", "turn", "role")


@_register("kv_slice_functions", "SELECT url AS key, starts_with(url, 'https') AS secure, ends_with(url, '.html') AS html, substr(url, 9, 5) AS part, CAST(strpos(url, '/en/') - 1 AS INTEGER) AS at, url || '#' || page_id AS joined FROM pages WHERE url IS NOT NULL")
def _(spark, sf):
    k = F.col("key")
    return url_state(spark, sf).select("key", slices.starts_with(k, "https").alias("secure"), slices.ends_with(k, ".html").alias("html"), slices.substr(k, 8, 5).alias("part"), slices.find(k, "/en/").alias("at"), slices.concat(k, F.lit("#"), F.col("page_id").cast("string")).alias("joined"))


@_register("kv_file_names", f"{C} SELECT seq, lpad(CAST(seq AS VARCHAR), 6, '0') || '.wal' AS wal, 'MANIFEST-' || lpad(CAST(seq AS VARCHAR), 6, '0') AS manifest FROM c")
def _(spark, sf):
    return event_log(spark, sf).select("seq", slices.wal_name(F.col("seq")).alias("wal"), slices.manifest_name(F.col("seq")).alias("manifest"))


@_register("kv_fixed64", f"{C} SELECT seq, hex((seq >> 0) & 255) || '-' || hex((seq >> 8) & 255) AS low_bytes FROM c")
def _(spark, sf):
    coded = codec.fixed_col(F.col("seq"))
    b = lambda i: F.hex(F.conv(F.hex(F.substring(coded, i + 1, 1)), 16, 10).cast("int"))
    return event_log(spark, sf).select("seq", F.concat_ws("-", b(0), b(1)).alias("low_bytes"))


@_register("kv_newest_k", f"{C} SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM c) WHERE rn <= 3")
def _(spark, sf):
    return _kv(merge.newest_k(event_log(spark, sf), 3))


@_register("kv_prefix_identity", "SELECT prefix, key, page_id FROM (SELECT substring(url, 1, 16) AS prefix, url AS key, page_id, row_number() OVER (PARTITION BY substring(url, 1, 16) ORDER BY page_id DESC) AS rn FROM pages WHERE url IS NOT NULL) WHERE rn = 1")
def _(spark, sf):
    """Keys that the prefix ordering takes for equal are one key: the newest record of each prefix."""
    u = url_state(spark, sf)
    c = changes(u, F.col("key"), F.col("page_id"), F.lit(1), F.col("page_id").cast("string")).withColumn("prefix", identity("prefix", F.col("key"), 16))
    return merge.latest(c, ("cf", "prefix")).select("prefix", "key", F.col("seq").alias("page_id"))


def _numbers(spark, sf):
    return table(spark, sf, "orders").select(codec.fixed_col(F.col("o_orderkey") * 37 % 100003).alias("key"), "o_orderkey")


@_register("kv_numeric_scan", "SELECT o_orderkey, n FROM (SELECT o_orderkey, o_orderkey * 37 % 100003 AS n FROM orders) WHERE n >= 255 AND n < 70000 ORDER BY n, o_orderkey LIMIT 300")
def _(spark, sf):
    start, end = ((x).to_bytes(8, "little") for x in (255, 70000))
    d = read.scan(_numbers(spark, sf), start, end, ordering="numeric64").select("o_orderkey", codec.read_fixed_col(F.col("key")).alias("n"))
    return d.orderBy("n", "o_orderkey").limit(300)


@_register("kv_numeric_reverse", "SELECT n FROM (SELECT DISTINCT o_orderkey * 37 % 100003 AS n FROM orders) ORDER BY n DESC LIMIT 40")
def _(spark, sf):
    d = _numbers(spark, sf).select("key").distinct()
    return read.scan(d, limit=40, reverse=True, ordering="numeric64").select(codec.read_fixed_col(F.col("key")).alias("n"))


register_ordering("text_length", lambda k: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(k)), 8, "0")), F.encode(k, "UTF-8")), lambda k: len(k).to_bytes(4, "big") + k)


@_register("kv_custom_ordering", "SELECT url AS key, page_id FROM pages WHERE url IS NOT NULL ORDER BY strlen(url), url LIMIT 25")
def _(spark, sf):
    return read.scan(url_state(spark, sf), limit=25, ordering="text_length")


@_register("kv_iterator_stats", f"{C} SELECT count(*) AS entries, CAST(sum(strlen(CAST(k AS VARCHAR))) AS BIGINT) AS key_bytes, CAST(sum(strlen(v)) AS BIGINT) AS value_bytes FROM {_latest('c')}")
def _(spark, sf):
    s = merge.latest(event_log(spark, sf)).withColumn("key", F.col("key").cast("string"))
    return read.iterator_stats(s)


@_register("kv_files_in_range", f"{C}, f AS ({META}) SELECT file, entries FROM f WHERE max_key >= 50 AND min_key <= 60")
def _(spark, sf):
    return stats.files_in_range(_files(spark, sf), 50, 60).select("file", "entries")


@_register("kv_unflushed_some", f"""{C}, t AS (SELECT * FROM cs WHERE state = 'committed' AND NOT flushed), n AS (SELECT k, count(*) AS n FROM t GROUP BY k),
 a AS (SELECT k, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM n) SELECT k, seq, v FROM t WHERE k IN (SELECT k FROM a WHERE ahead < 200)""")
def _(spark, sf):
    return _kv(merge.unflushed(with_state(event_log(spark, sf)), 200))


@_register("kv_mark_flushed", f"{C} SELECT k, seq, flushed OR k % 2 = 0 AS flushed FROM cs")
def _(spark, sf):
    c = with_state(event_log(spark, sf))
    return merge.mark_flushed(c, c.filter("key % 2 = 0")).select(F.col("key").alias("k"), "seq", "flushed")


@_register("kv_intervals_in_pieces", f"{C} SELECT k, seq, lead(seq) OVER (PARTITION BY k ORDER BY seq) AS next_seq FROM c")
def _(spark, sf):
    return merge.intervals(event_log(spark, sf), pieces=16).select(F.col("key").alias("k"), "seq", "next_seq")


def _lookups(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("probe_id"), F.lit("default").alias("cf"), (F.col("c_custkey") % 150).alias("key"), (F.col("c_custkey") * 7919 % 120000).alias("at_seq"))


@_register("kv_asof_all_customers", f"""{C}, p AS (SELECT c_custkey AS probe_id, c_custkey % 150 AS k, c_custkey * 7919 % 120000 AS at_seq FROM customer)
 SELECT probe_id, k, at_seq, CASE WHEN op <> 2 THEN seq END AS seq FROM (SELECT p.*, c.seq, c.op FROM p ASOF LEFT JOIN c ON p.k = c.k AND p.at_seq >= c.seq)""")
def _(spark, sf):
    return merge.as_of_batch(_lookups(spark, sf), event_log(spark, sf)).select("probe_id", F.col("key").alias("k"), "at_seq", "seq")


BYTES = " || ".join(f"lpad(hex((seq >> {8 * i}) & 255), 2, '0')" for i in range(8))


@_register("kv_fixed64_codec", f"{C} SELECT seq, {BYTES} AS bytes, seq AS back FROM c")
def _(spark, sf):
    coded = codec.fixed_col(F.col("seq"))
    return event_log(spark, sf).select("seq", F.hex(coded).alias("bytes"), codec.read_fixed_col(coded).alias("back"))


@_register("kv_varint_codec", f"""{C} SELECT seq, CASE WHEN seq < 128 THEN lpad(hex(seq), 2, '0') WHEN seq < 16384 THEN lpad(hex((seq & 127) | 128), 2, '0') || lpad(hex(seq >> 7), 2, '0')
 ELSE lpad(hex((seq & 127) | 128), 2, '0') || lpad(hex(((seq >> 7) & 127) | 128), 2, '0') || lpad(hex(seq >> 14), 2, '0') END AS bytes, seq AS back FROM c""")
def _(spark, sf):
    coded = codec.varint_col(F.col("seq"))
    return event_log(spark, sf).select("seq", F.hex(coded).alias("bytes"), codec.read_varint_col(coded).alias("back"))


@_register("kv_internal_key_codec", f"{C} SELECT CAST(k AS VARCHAR) AS k, seq, CAST(op AS INTEGER) AS op, strlen(CAST(k AS VARCHAR)) + 8 AS n FROM c")
def _(spark, sf):
    coded = codec.internal_key_col(F.col("key").cast("string"), F.col("seq"), F.col("op"))
    back = codec.read_internal_key_col(coded)
    return event_log(spark, sf).select(F.decode(back["key"], "UTF-8").alias("k"), back["seq"].alias("seq"), back["op"].alias("op"), F.octet_length(coded).cast("long").alias("n"))


CODES = "list_transform(string_split(CAST(k AS VARCHAR), ''), lambda x: CAST(ascii(x) AS HUGEINT))"


@_register("kv_key_hashes", f"""{C} SELECT DISTINCT k, CAST(list_reduce(list_prepend(0::HUGEINT, {CODES}), lambda a, b: a * 31 + b) AS BIGINT) AS slice_hash,
 CAST(list_reduce(list_prepend(2166136261::HUGEINT, {CODES}), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS BIGINT) AS fnv FROM c""")
def _(spark, sf):
    k = F.col("key").cast("string").cast("binary")
    return event_log(spark, sf).select("key").distinct().select(F.col("key").alias("k"), codec.slice_hash_col(k).alias("slice_hash"), codec.fnv1a_col(k).alias("fnv"))


@_register("kv_crc_mask", f"{C} SELECT seq, (((x >> 15) | ((x << 17) & 4294967295)) + 2726488792) & 4294967295 AS masked, x AS back FROM (SELECT seq, (seq * 2654435761) & 4294967295 AS x FROM c)")
def _(spark, sf):
    x = (F.col("seq") * 2654435761).bitwiseAND(F.lit(4294967295))
    masked = codec.crc_mask_col(x)
    return event_log(spark, sf).select("seq", masked.alias("masked"), codec.crc_unmask_col(masked).alias("back"))


@_register("kv_bloom_members", f"{C} SELECT cf, count(DISTINCT k) AS members, count(DISTINCT k) AS found FROM c GROUP BY cf")
def _(spark, sf):
    keys = event_cf_log(spark, sf).select("cf", "key").distinct()
    n = keys.groupBy("cf").agg(F.count("*").alias("n"))
    sizes = n.withColumn("bits", stats.bloom_bits(F.col("n"), 0.01)).withColumn("hashes", stats.bloom_hashes(F.col("bits"), F.col("n"))).drop("n")
    tested = bloom.test(keys, bloom.create(keys, sizes, "cf"), sizes, "cf")
    return tested.groupBy("cf").agg(F.count("*").alias("members"), F.count_if("maybe").alias("found"))


@_register("kv_bloom_rate", f"""{C}, n AS (SELECT cf, count(DISTINCT k) AS n FROM c GROUP BY cf), b AS (SELECT cf, n, CAST(ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits FROM n),
 h AS (SELECT *, CAST(greatest(1, floor(CAST(bits AS DOUBLE) / n * ln(2) + 0.5)) AS BIGINT) AS hashes FROM b) SELECT cf, round(pow(1 - exp(-hashes * n / CAST(bits AS DOUBLE)), hashes), 9) AS rate FROM h""")
def _(spark, sf):
    n = event_cf_log(spark, sf).groupBy("cf").agg(F.countDistinct("key").alias("n"))
    n = n.withColumn("bits", stats.bloom_bits(F.col("n"), 0.01)).withColumn("hashes", stats.bloom_hashes(F.col("bits"), F.col("n")))
    return n.select("cf", F.round(stats.bloom_rate(F.col("bits"), F.col("n"), F.col("hashes")), 9).alias("rate"))


@_register("kv_file_bytes", f"{C}, f AS ({META}) SELECT file, raw_key_bytes + raw_value_bytes + entries * 20 + 1024 AS bytes FROM f")
def _(spark, sf):
    return _files(spark, sf).select("file", stats.estimate_file_bytes(F.col("raw_key_bytes") + F.col("raw_value_bytes"), F.col("entries")).alias("bytes"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["kv_latest_state"](spark, sf)
