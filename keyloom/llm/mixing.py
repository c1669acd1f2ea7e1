"""Mix sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: sources in code point order, null last, weigh 1, 2, 3, repeating, and
share the whole size; a target is at most ``max_repeat`` times its source's
size and the excess is shared again by weight.  The fixed point of that sharing
is min(cap, level * weight); sorted by cap / weight, running sums give it in one
pass over the table of sources, which has one row per source.

Copies: a document of ``size`` words is expected ``x = scale / sqrt(size)`` times
in the mix, at most ``max_repeat`` times: longer documents, which cost more of
the target, are repeated less.  ``scale`` is set for each source so that expected
words meet its target; again running sums, over one row for each size, give it.
The whole part of ``x`` is taken for certain; the rest is the document's own
inclusion probability ``p``.  Each source is parted into classes of documents of
about equal size (four for each doubling).  From the largest class down, each
draws as many as bring its expected words nearest, at the class's mean size;
what that leaves or overdraws goes to the next class.  So sample sizes are fixed
before anything is drawn.  A class draws the documents with the smallest Pareto
ranks ``odds(u) / odds(p)``, u a hash of the id.

Ranks fall into ``bins`` bins of each class, of about equal probability; sums over
bins and an order inside each bin replace one order per class, so a source with
a third of all rows spreads over all tasks.

Extra columns are ignored.  Text null or without words: size 0, taken 0.  A source of size 0 gets target 0.
Repeated ids share u and are ordered by size and then text hash; equal rows are
interchangeable.  Null ids hash as an empty string.  Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, text_of, written

BINS, BILLION = 4096, 1_000_000_000


def targets(sources: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target); one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * F.lit(float(max_repeat))
    s = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The level with which the first source that is not capped, and all after it, are served.
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    s = s.withColumn("level", F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))).select("source", "source_size", "weight", "target")


def uniform(id_col: str, seed: int):
    """A number in (0, 1) from the id alone."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def scales(sizes: DataFrame, goals: DataFrame, max_repeat: float) -> DataFrame:
    """(source, scale) from one row (source, size, n) for each size; no scale where all documents are at the cap."""
    s = sizes.join(goals.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s")))
    order = Window.partitionBy("source").orderBy("size")
    capped = F.sum(F.col("size") * F.col("n") * F.lit(float(max_repeat))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    roots = F.sum(F.sqrt("size") * F.col("n")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("scale", (F.col("target") - F.coalesce(capped, F.lit(0.0))) / roots)
    free = F.col("scale") / F.sqrt("size") <= max_repeat
    return s.groupBy("source").agg(F.min_by(F.when(free, F.col("scale")), F.when(free, F.col("size"))).alias("scale"))


def size_class(size: Column) -> Column:
    """Four classes for each doubling of the size."""
    bits = F.length(F.bin(size))
    return F.when(size > 0, bits * 4 + F.floor(size * 8 / F.pow(F.lit(2.0), bits)) - 4).otherwise(0).cast("int")


def inclusion(docs: DataFrame, max_repeat: float = 3.0, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, u, tie, source_size, target, certain, p, class) for every document; p in billionths."""
    text = text_of("text")
    slim = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), uniform("doc_id", seed).alias("u"), F.xxhash64(text).alias("tie"))
    slim = written(slim, "sizes")
    sizes = written(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    goals = written(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), max_repeat), "goals")
    scale = scales(sizes.filter("size > 0"), goals, max_repeat)
    goals = goals.join(scale.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    # A struct key, as a null source is a source like any other.  One row per source on the right.
    goals = goals.select(F.struct(F.col("source").alias("s")).alias("_key"), "source_size", "target", "scale")
    d = slim.withColumn("_key", F.struct(F.col("source").alias("s"))).join(goals, "_key").drop("_key")
    x = F.least(F.lit(float(max_repeat)), F.coalesce(F.col("scale") / F.sqrt("size"), F.lit(float(max_repeat))))
    d = d.withColumn("x", F.when((F.col("size") > 0) & (F.col("target") > 0), x).otherwise(0.0))
    d = d.withColumn("certain", F.floor(F.col("x") + 1e-9).cast("long"))
    p = F.round(F.greatest(F.lit(0.0), F.col("x") - F.col("certain")) * BILLION).cast("long")
    return d.withColumn("p", p).withColumn("class", size_class(F.col("size"))).drop("x", "scale")


def draws(d: DataFrame) -> DataFrame:
    """(source, class, draws, mean): how many documents each class draws, and the mean of its probabilities."""
    words = F.sum((F.col("p") * F.col("size")).cast("decimal(20,0)")).cast("double") / BILLION
    c = d.groupBy("source", "class").agg(words.alias("words"), (F.sum("size") / F.count("*")).alias("size"), F.count_if(F.col("p") > 0).alias("most"), (F.sum("p") / F.count("*") / BILLION).alias("mean"))
    # At most four classes for each doubling of a size: a short list for each source.
    lists = c.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "words", "size", "most", "mean")), asc=False).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        due = acc["left"] + x["words"]
        n = F.when(x["size"] > 0, F.least(F.greatest(F.floor(due / x["size"] + 0.5), F.lit(0)), x["most"])).otherwise(0).cast("long")
        return F.struct((due - n * x["size"]).alias("left"), F.concat(acc["out"], F.array(F.struct(x["class"].alias("class"), n.alias("draws"), x["mean"].alias("mean")))).alias("out"))

    zero = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<struct<class:int,draws:bigint,mean:double>>").alias("out"))
    return lists.select("source", F.inline(F.aggregate("all", zero, step)["out"]))


def mix(docs: DataFrame, max_repeat: float = 3.0, seed: int = 7, bins: int = BINS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every document."""
    d = inclusion(docs, max_repeat, seed)
    key = F.struct(F.col("source").alias("s"), F.col("class").alias("c"))
    # Written, a few rows a source: Spark knows their size and broadcasts them while it is small.
    classes = written(draws(d).select(key.alias("_key"), "draws", "mean"), "classes")
    d = d.withColumn("_key", key).join(classes, "_key")
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = lambda c: c / (1 - c)
    d = d.withColumn("rank", odds(F.col("u")) / odds(inside(F.col("p") / BILLION)))
    even = F.col("rank") * odds(inside(F.col("mean")))  # about the odds of a uniform number
    d = d.withColumn("bin", F.floor(even / (1 + even) * bins).cast("int"))
    d = d.repartition("_key", "bin")  # never by class alone, whichever way the join went
    sums = d.groupBy("_key", "bin").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "bin", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("_key", "bin").orderBy("rank", "doc_id", "size", "tie"))
    d = d.join(sums, ["_key", "bin"])
    extra = (F.col("before") + place <= F.col("draws")) & (F.col("p") > 0)
    d = d.withColumn("copies", F.col("certain") + extra.cast("long"))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
, z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
 zw AS (SELECT z.source, z.size, (g.target - coalesce(sum(z.size * z.n * 3.0::DOUBLE) OVER (PARTITION BY z.source ORDER BY z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(sqrt(z.size) * z.n) OVER (PARTITION BY z.source ORDER BY z.size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM z JOIN goal g ON z.source IS NOT DISTINCT FROM g.source),
 sc AS (SELECT source, min_by(scale, size) AS scale FROM zw WHERE scale / sqrt(size) <= 3 GROUP BY source),
 x AS (SELECT d.*, g.source_size, g.target, CASE WHEN d.size > 0 AND g.target > 0 THEN least(3.0::DOUBLE, coalesce(sc.scale / sqrt(d.size), 3.0)) ELSE 0.0 END AS x,
   CASE WHEN d.size > 0 THEN length(bin(d.size)) * 4 + CAST(floor(d.size * 8 / pow(2.0, length(bin(d.size)))) AS BIGINT) - 4 ELSE 0 END AS class
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN sc ON d.source IS NOT DISTINCT FROM sc.source),
 p AS (SELECT *, floor(x + 1e-9) AS certain, CAST(round(greatest(0.0, x - floor(x + 1e-9)) * 1000000000) AS BIGINT) AS p FROM x),
 c AS (SELECT source, class, CAST(sum(p * size) AS DOUBLE) / 1000000000 AS words, sum(size) / count(*) AS mean, count(*) FILTER (p > 0) AS most,
   row_number() OVER (PARTITION BY source ORDER BY class DESC) AS k FROM p GROUP BY source, class),
 n(source, class, k, rest, draws) AS (
  SELECT source, class, k, words - draws * mean, draws FROM (SELECT *, CASE WHEN mean > 0 THEN CAST(least(greatest(floor(words / mean + 0.5), 0), most) AS BIGINT) ELSE 0 END AS draws FROM c WHERE k = 1)
  UNION ALL
  SELECT source, class, k, due - draws * mean, draws FROM (SELECT c.*, n.rest + c.words AS due, CASE WHEN c.mean > 0 THEN CAST(least(greatest(floor((n.rest + c.words) / c.mean + 0.5), 0), c.most) AS BIGINT) ELSE 0 END AS draws
   FROM n JOIN c ON c.source IS NOT DISTINCT FROM n.source AND c.k = n.k + 1)),
 r AS (SELECT p.*, n.draws, row_number() OVER (PARTITION BY p.source, p.class ORDER BY (u / (1 - u)) / ((greatest(least(p / 1e9, 1 - 1e-12), 1e-12)) / (1 - greatest(least(p / 1e9, 1 - 1e-12), 1e-12))), doc_id, size) AS place
  FROM p JOIN n ON p.source IS NOT DISTINCT FROM n.source AND p.class = n.class)
SELECT doc_id, size, source_size, target, CAST((certain + CASE WHEN p > 0 AND place <= draws THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""

GOAL_SQL = r"""
 d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  (CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':7'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM docs),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
 l AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
  (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
 v AS (SELECT min(level) AS level FROM (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1)),
 goal AS (SELECT source, source_size, weight, coalesce(least(cap, v.level * weight), cap) AS target FROM l, v)
"""

SQL = f"WITH RECURSIVE docs AS (SELECT * FROM documents), {GOAL_SQL} {MIX_SQL}"
