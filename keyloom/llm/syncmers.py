"""Document fingerprints from closed syncmers, with DataFrame functions only.

A k-mer of ``K`` characters is chosen when the smallest hash among its inner
substrings of ``S`` characters is that of its first or its last one.  That
depends on the k-mer alone, so equal passages give equal anchors wherever they
stand, in any script and with or without spaces, and two neighbouring anchors
are at most ``K - S`` apart.  A fingerprint holds all anchors of a text in
order: for each a hash of six bytes and the distance to the one before in one
byte, in base64; ``anchors`` gives their offsets.  A text in which nothing is
chosen (it has fewer than ``K`` characters) has the hash of the whole.  Likeness
is the share of common hashes among the distinct hashes of both.

Texts are cut into chunks that overlap by ``K - 1`` characters, so the work
arrays are small however long a text is.  An edited text keeps the anchors of
its unchanged start; only the rest is read again.

The next document is found inside blocks of neighbouring rows in the order of
(doc_id, hash of the text): block bounds are quantiles of the ids, an id that
fills several blocks is split by the hash, each block also gets the first row of
the next one, and one exchange by block serves both windows.

Text null counts as empty; empty text: empty fingerprint, like an empty one (1)
and like no other (0).  Null ids come first; of rows that repeat an id, that
with the smaller text hash comes first, and equal rows are interchangeable
(copies of one row with one id share a block).  A table of one row is its own
next document.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from keyloom.llm.common import let, text_of

K, S, CHUNK = 40, 8, 640
_INNER = K - S + 1
_LEAST = -(1 << 63)
_ANCHORS = "array<struct<pos:int,hash:bigint>>"


def _edge(h: Column, first: Column, i: Column) -> Column:
    """Whether the smallest of the hashes i .. i + _INNER - 1 is the first or the last; null where they would pass the end."""
    at = lambda j: F.get(h, i + j)
    last = at(_INNER - 1)
    all_of = lambda x: reduce(lambda rest, j: (x <= at(j)) & rest, reversed(range(1, _INNER - 2)), x <= at(_INNER - 2))
    # The larger of both can't be the smallest of all; a chain ends at the first hash below.
    return F.when(first <= last, all_of(first)).otherwise(all_of(last))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{CHUNK + K - 1}}})).{{1,{CHUNK}}}"), F.lit(1))


def _inner(chunk: Column) -> Column:
    """The hashes of all inner substrings of a chunk."""
    return F.transform(F.regexp_extract_all(chunk, F.lit(rf"(?s)(?=(.{{{S}}}))."), F.lit(1)), lambda x: F.xxhash64(x))


def _hash(chunk: Column, i: Column) -> Column:
    """The hash of the k-mer at i of a chunk, 48 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.substring(chunk, i + 1, F.lit(K))), 16)


def anchors(text: Column) -> Column:
    """array<struct<pos, hash>>: the chosen k-mers of a text, by position."""

    def of(c: Column, k: Column) -> Column:
        anchor = lambda i: F.struct((k * CHUNK + i).alias("pos"), _hash(c, i).alias("hash"))
        return let(_inner(c), lambda h: F.filter(F.transform(h, lambda x, i: F.when(_edge(h, x, i), anchor(i))), lambda a: a.isNotNull()))

    return F.flatten(F.transform(_chunks(text), of))


def _or_whole(found: Column, digest: Column, n: Column) -> Column:
    """The anchors, or the hash of the whole where a text of n characters has none."""
    whole = F.struct(F.lit(0).alias("pos"), F.shiftrightunsigned(digest, 16).alias("hash"))
    return let(found, lambda x: F.when((F.size(x) > 0) | (n == 0), x).otherwise(F.array(whole).cast(_ANCHORS)))


def packed(found: Column) -> Column:
    """The fingerprint string of a text's anchors."""
    gap = lambda x, i: x["pos"] - F.when(i > 0, F.get(found, i - 1)["pos"]).otherwise(0)
    each = F.transform(found, lambda x, i: F.lpad(F.hex(F.shiftleft(x["hash"], 8) + gap(x, i)), 14, "0"))
    return F.base64(F.unhex(F.array_join(each, "")))


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of both that both have; both distinct."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(shared / F.greatest(both - shared, F.lit(1)))


def fingerprint(text: Column) -> Column:
    t = text_of(text)
    return let(_or_whole(anchors(t), F.xxhash64(t), F.length(t)), packed)


def _gathered(docs: DataFrame) -> DataFrame:
    """(block, doc, own, end) of (block, doc, text, tail, base): the anchors of text, and those of tail moved by base.

    The same anchors as those of ``anchors``, but inner hashes are rows here: their
    comparisons run as generated code, where those of a lambda are interpreted.
    What is gathered stays in its block's partition.  Each document has one empty
    chunk more, whose row carries ``doc`` (the outer explode keeps it).
    """
    chunk = lambda at, c, own: F.struct(at.alias("at"), c.alias("c"), F.lit(own).alias("own"))
    own = F.transform(_chunks(F.col("text")), lambda c, k: chunk(k * CHUNK, c, True))
    end = F.transform(_chunks(F.col("tail")), lambda c, k: chunk(F.col("base") + k * CHUNK, c, False))
    d = docs.select("block", F.monotonically_increasing_id().alias("row"), "doc", F.concat(F.array(chunk(F.lit(0), F.lit(""), True)), own, end).alias("chunks"))
    d = d.select("block", "row", "doc", F.posexplode("chunks").alias("k", "chunk"))
    d = d.select("block", "row", F.when(F.col("k") == 0, F.col("doc")).alias("doc"), "chunk.*", _inner(F.col("chunk.c")).alias("h"))
    d = d.select("block", "row", "doc", "at", "c", "own", "h", F.posexplode_outer("h").alias("i", "first"))
    i, at = F.col("i"), lambda j: F.get("h", F.col("i") + j)
    least = F.least("first", at(_INNER - 1))
    # A few comparisons first: few rows are left for the minimum of them all.
    edge = reduce(lambda rest, j: rest & (least <= at(j)), range(1, 5), i + _INNER <= F.size("h")) & (least <= F.array_min(F.slice("h", i + 1, _INNER)))
    d = d.filter(i.isNull() | edge)
    # A place inside the chunk and a hash of 48 bits are one number, so what a document has is small until its row is made.
    found = F.when(i.isNotNull(), F.shiftleft(i.cast("bigint"), 48) + _hash(F.col("c"), i))
    d = d.select("block", "row", "at", "own", "doc", found.alias("found"))
    d = d.groupBy("block", "row", "at", "own").agg(F.first("doc", ignorenulls=True).alias("doc"), F.sort_array(F.collect_list("found")).alias("found"))
    unpacked = lambda at, v: F.struct((at + F.shiftright(v, 48).cast("int")).alias("pos"), v.bitwiseAND(F.lit((1 << 48) - 1)).alias("hash"))
    moved = lambda chunk: F.transform(chunk["found"], lambda v: unpacked(chunk["at"], v))
    of = lambda own: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("own") == own, F.struct("at", "found")))), moved))
    return d.groupBy("block", "row").agg(F.first("doc", ignorenulls=True).alias("doc"), of(True).alias("own"), of(False).alias("end")).drop("row")


def _bounds(docs: DataFrame, blocks: int) -> list[tuple[int, int]]:
    """Fewer than ``blocks`` ascending bounds (id, hash) that part the table into blocks of about equal size."""
    share = [i / blocks for i in range(1, blocks)]
    known = F.coalesce("doc_id", F.lit(_LEAST))
    got = docs.agg(F.percentile_approx(known, share, 10 * blocks).alias("q")).first()["q"] if share else None
    out: list[tuple[int, int]] = []
    for q in sorted(set(got or [])):
        times = got.count(q)
        out += [(q, _LEAST + j * ((1 << 64) // times)) for j in range(times)]
    return out


def _block(bounds: list[tuple[int, int]]) -> Column:
    """How many bounds are at or below the row, by binary search."""
    if not bounds:
        return F.lit(0)
    known = F.from_json(F.lit(json.dumps([{"i": i, "t": t} for i, t in bounds])), "array<struct<i:bigint,t:bigint>>")
    row = F.struct(F.coalesce("doc_id", F.lit(_LEAST)).alias("i"), F.col("tie").alias("t"))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    step = lambda acc, s: F.when((acc + s <= len(bounds)) & (F.get(known, acc + s - 1) <= row), acc + s).otherwise(acc)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(doc_id, text, block, tie, last) in blocks; rows with ``last`` are copies of the next block's first row."""
    spark = docs.sparkSession
    if blocks is None:
        blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"))
    bounds = _bounds(slim, blocks)
    rows = slim.withColumn("tie", F.xxhash64("text")).withColumn("block", _block(bounds))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    # A row of two numbers for each block, whatever the table holds.
    firsts = sorted(rows.groupBy("block").agg(F.min(order).alias("f")).collect(), key=lambda r: r["block"])
    if not firsts:
        return rows.withColumn("last", F.lit(False))
    goes_to = {}
    for k, r in enumerate(firsts):
        goes_to.setdefault((r["f"]["doc_id"], r["f"]["tie"]), firsts[k - 1]["block"])
    table = spark.createDataFrame([(d, t, b) for (d, t), b in goes_to.items()], "f_id bigint, f_tie bigint, goes_to int")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("tie") == F.col("f_tie"))
    heads = rows.join(F.broadcast(table), same)  # as many rows as blocks
    heads = heads.groupBy("doc_id", "tie", "goes_to").agg(F.first("text").alias("text"))
    heads = heads.select("doc_id", "text", F.col("goes_to").alias("block"), "tie", F.lit(True).alias("last"))
    return rows.withColumn("last", F.lit(False)).unionByName(heads)


def _order() -> WindowSpec:
    return Window.partitionBy("block").orderBy("last", F.col("doc_id").asc_nulls_first(), "tie")


def _edits(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(block, doc, text, tail, base) as ``_gathered`` takes them; doc has lengths and digests."""
    d = with_next(docs, blocks).withColumn("next", F.lead("text").over(_order()))
    n = F.length("text")
    d = d.withColumn("n", n).withColumn("same", n - F.floor(n / 4).cast("int"))
    d = d.withColumn("new", F.coalesce(F.when(~F.col("last"), F.col("next").substr(F.lit(1), F.col("n") - F.col("same"))), F.lit("")))
    d = d.withColumn("start", F.substring("text", F.lit(1), F.col("same"))).withColumn("edited", F.concat("start", "new"))
    d = d.withColumn("base", F.greatest(F.lit(0), F.col("same") - (K - 1)))
    d = d.withColumn("tail", F.when(F.col("new") == "", F.lit("")).otherwise(F.concat(F.substring("start", F.col("base") + 1, F.lit(K - 1)), "new")))
    doc = F.struct(
        *("doc_id", "tie", "last", "same", F.col("n").cast("long").alias("n_chars")),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.xxhash64("edited").alias("edited_tie"),
    )
    return d.select("block", doc.alias("doc"), "text", "tail", "base")


def edited(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    d = _gathered(_edits(docs, blocks)).select("block", "doc.*", "own", "end")
    d = d.withColumn("fp", _or_whole(F.col("own"), F.col("tie"), F.col("n_chars")))
    unchanged = F.filter("own", lambda x: x["pos"] <= F.col("same") - K)
    d = d.withColumn("edited_fp", _or_whole(F.concat(unchanged, "end"), F.col("edited_tie"), F.col("n_chars")))
    d = d.select(
        *("doc_id", "block", "tie", "last", "n_chars", "edited_sha256"),
        packed(F.col("fp")).alias("fingerprint"),
        packed(F.col("edited_fp")).alias("edited_fingerprint"),
        hashes(F.col("fp")).alias("fp"),
        hashes(F.col("edited_fp")).alias("edited_fp"),
    )
    d = d.withColumn("near_edited", likeness(F.col("fp"), F.col("edited_fp"))).drop("edited_fp")
    d = d.withColumn("next_fp", F.lead("fp").over(_order())).filter(~F.col("last"))
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``query`` that need no fingerprint."""
    d = _edits(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc.*")
    return d.filter(~F.col("last")).select("doc_id", "n_chars", "edited_sha256")


#: The columns that SQL can express.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS next, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS head FROM documents)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(coalesce(next, head), 1, length(t) // 4)) AS edited_sha256 FROM d
"""
