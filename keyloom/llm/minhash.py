"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges, full check.

1. Every document becomes the set of its 5-word shingles (64-bit hashes), a
   128-bit digest of that set, and a one-permutation signature of ``BINS`` bins
   with optimal densification: an empty bin takes the value of the bin that a
   hash of (bin, attempt) names, trying on until that one isn't empty.
2. Documents with equal sets are one class from here on.
3. ``BANDS`` bands of ``ROWS`` bins give buckets.  At similarity 0.85 two sets
   share no bucket with a chance of (1 - 0.85**5)**25 = 4e-7.
4. Between classes that both sit in a bucket of more than ``WIDE`` classes, two
   exact bounds leave few pairs that are near but not linked: own shingles (those
   that no other such class has) must leave room for the link, and among the
   rarest shingles of each, as many as a link can miss and one more, there must be
   a common one.  A class with too many own shingles can't be linked to any such
   class, so it leaves the buckets of more than ``WIDE``, where all are such.
   Classes of smaller buckets only were not counted: nothing is bounded against
   them, and they meet at most ``WIDE`` in a bucket.  Before texts are
   sent anywhere, a pair must also pass by its profiles: how many shingles fall
   into each of some hundred slots bounds how many two sets can share.
5. Star edges: in each bucket every class is paired with ``CENTRES`` centres, the
   classes with the smallest share of own shingles, so pairs grow with the
   members of buckets and not with their squares.  Pairs are checked on the full
   sets and joined to components.
6. A bucket whose members now lie in one component can hold no further link
   that matters.  In the others, members outside the bucket's largest component
   are checked against all members of other components that the bounds leave,
   so nothing is lost beside the chance in 3.  Here pairs of wide classes are told
   apart by their rarest common shingle.  If at most ``WIDE`` classes have it, it
   is among the rarest of both and they meet at that shingle, each with less than
   ``WIDE`` others.  If not, they share frequent shingles only, and these must be
   enough for the link: a class whose frequent shingles aren't enough for any
   size in its bucket leaves it, so copies with too many edits meet nobody there.

Links: 100 * |A and B| >= ``percent`` * |A or B|.  Fewer than five words: the
whole sequence is the one shingle.  Text null or without words: empty set,
linked with nothing, kept.  Rows are the documents: a repeated row is a copy of
the first, and both carry the same id.  A null id sorts above all others when a
component is named.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import small_batches, temporary, text_of, written

WORDS, BANDS, ROWS, CENTRES, WIDE, PERCENT = 5, 25, 5, 3, 32, 85
BINS = 128
_C = [np.uint64(c | 1) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_hash = xxhash.xxh3_64_intdigest


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The document's set, as sorted 64-bit hashes."""
    # bytes.lower and bytes.split know ASCII only: A-Z and the six white space characters.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hash, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    if n < 1:
        return np.array([_hash(b" ".join(words), len(words))], np.uint64)
    out = w[:n] * _C[0]
    for j in range(1, WORDS):
        out = (out ^ (out >> np.uint64(31))) * _C[j] + w[j : j + n] * _C[j + 1]
    return np.unique(_mix(out))


def _probes() -> np.ndarray:
    """For each bin the bins to borrow from, in order; the same for all documents."""
    b, t = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(1, 16 * BINS, dtype=np.uint64), indexing="ij")
    return (_mix(b * _C[1] + t * _C[2]) % np.uint64(BINS)).astype(np.int64)


_PROBES = _probes()
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a set that isn't empty, densified."""
    h = _mix(s + _C[3])
    out = np.full(BINS, _EMPTY, np.uint64)
    np.minimum.at(out, (h >> np.uint64(57)).astype(np.int64), h & np.uint64((1 << 57) - 1))
    full = out != _EMPTY
    if not full.all():
        empty = np.flatnonzero(~full)
        hits = full[_PROBES[empty]]
        first = hits.argmax(1)
        lender = _PROBES[empty, first]
        lender[~hits[np.arange(len(empty)), first]] = np.flatnonzero(full)[0]
        out[empty] = out[lender]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    x = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) * _C[4]
    for j in range(ROWS):
        out = (out ^ (out >> np.uint64(29))) * _C[j] + x[:, j]
    return _mix(out).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n, node, bands): a row for each document; node is null for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            ns, nodes, bs = [], [], []
            for t in pdf["text"]:
                s = shingles(t)
                ns.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bs.append(bands(signature(s)) if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tk": pdf["tk"], "n": np.array(ns, np.int64), "node": nodes, "bands": bs})

    return docs.select("doc_id", F.xxhash64(text_of("text")).alias("tk"), "text").mapInPandas(run, f"doc_id {kind}, tk long, n long, node binary, bands array<long>")


def rarest(texts: DataFrame, percent: int) -> DataFrame:
    """(id, own, often, rare, keys): how many shingles of each class no other class of the table has and how many more than ``WIDE`` have,
    the rarest ones of which linked classes share one, and those of them that 2 to ``WIDE`` classes have; id hashes the node."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "h": [shingles(t).view(np.int64) for t in pdf["text"]]})

    sets = texts.select(F.xxhash64("node").alias("id"), "text").mapInPandas(run, "id long, h array<long>")
    each = sets.select("id", F.explode("h").alias("h"))
    # Written, so that the join has exchanges of its own and a shingle that many classes have can be split.
    common = written(each.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "common")
    each = each.join(common, "h", "left").select("id", F.coalesce("m", F.lit(1)).alias("m"), "h")
    lists = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("m", "h"))).alias("s"))
    n = F.size("s")
    misses = n - F.ceil(n * percent / 100).cast("int")
    own, often = (F.size(F.filter("s", f)) for f in (lambda x: x["m"] == 1, lambda x: x["m"] > WIDE))
    keys = F.filter(F.slice("s", 1, misses + 1), lambda x: x["m"].between(2, WIDE))["h"]
    return lists.select("id", own.alias("own"), often.alias("often"), F.slice(F.col("s.h"), 1, misses + 1).alias("rare"), keys.alias("keys"))


def _profile(s: np.ndarray) -> bytes:
    """How many shingles have the same leading bits; more bits for larger sets."""
    bits = 8 if len(s) < 500 else 10 if len(s) < 4000 else 12
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32).tobytes()


def may_link(a: bytes, b: bytes, percent: int) -> bool:
    """False only if sets with these profiles can't be linked."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if len(x) != len(y):
        n = min(len(x), len(y))
        x, y = x.reshape(n, -1).sum(1), y.reshape(n, -1).sum(1)
    both = int(np.minimum(x, y).sum())
    return 100 * both >= percent * (int(x.sum()) + int(y.sum()) - both)


def profiles(texts: DataFrame) -> DataFrame:
    """(node, profile) of every class."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "profile": [_profile(shingles(t)) for t in pdf["text"]]})

    return texts.select("node", "text").mapInPandas(run, "node binary, profile binary")


def possible(pairs: DataFrame, profile: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their profiles leave possible."""
    left, right = (profile.select(F.col("node").alias(c), F.col("profile").alias(f"p{c}")) for c in "ab")

    def run(batches):
        for pdf in batches:
            yield pdf.loc[[may_link(x, y, percent) for x, y in zip(pdf["pa"], pdf["pb"], strict=True)], ["a", "b"]]

    return pairs.join(right, "b").join(left, "a").select("a", "b", "pa", "pb").mapInPandas(run, "a binary, b binary")


def check(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are linked, judged on their full sets."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        cache: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(node: bytes, text: str) -> np.ndarray:
            got = cache.get(node)
            if got is None:
                got = cache[node] = shingles(text)
                if len(cache) > 64:
                    cache.popitem(last=False)
            else:
                cache.move_to_end(node)
            return got

        for pdf in batches:
            ok = [linked(of(bytes(a), ta), shingles(tb), percent) for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return joined.mapInPandas(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the edges (a, b): the smallest node reachable.

    Each round points every node at its smallest neighbour or itself and
    contracts; the number of rounds grows with the logarithm of the longest path.
    """
    e, labels = written(edges.filter("a <> b").select("a", "b").distinct(), "edges"), None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "step")
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("to").alias("label"))
        else:
            moved = labels.join(step.withColumnRenamed("a", "label"), "label", "left")
            labels = written(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = e.join(step.select("a", F.col("to").alias("x")), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        e = written(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def groups(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tk, n, node) for every row, and (node, id, tk) for the classes of groups of several rows: the group's first row."""
    with temporary() as keep:
        sk, named = _groups(docs.select("doc_id", "text"), percent)
        return keep(sk), keep(named)


def _groups(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    with small_batches(docs.sparkSession):
        sk = written(sketches(docs), "sketch")
    has = sk.filter(F.col("node").isNotNull())
    # Copies of a class meet in a map-side combine first, so a group of any size is one row a task.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tk")).alias("rep")
    nodes = written(has.groupBy("node").agg(first, F.first("bands").alias("bands"), F.first("n").alias("n"), F.count("*").alias("copies")), "nodes")

    spread = nodes.select(F.explode("bands").alias("bucket"), "node", "n")
    sizes = written(spread.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    near = written(spread.join(sizes.hint("merge"), "bucket"), "near")
    wanted = near.groupBy("node").agg((F.max("m") > WIDE).alias("wide")).join(nodes.select("node", "rep"), "node")
    wanted = wanted.select("node", "wide", F.col("rep.doc_id").alias("doc_id"), F.col("rep.tk").alias("tk"))
    keyed = docs.withColumn("tk", F.xxhash64(text_of("text")))
    same = (keyed["tk"] == wanted["tk"]) & keyed["doc_id"].eqNullSafe(wanted["doc_id"])
    # The same way for every size: no broadcast of what grows with the corpus.
    texts = written(keyed.join(wanted.hint("merge"), same).select("node", "wide", "text"), "texts")
    with small_batches(docs.sparkSession):
        profile = written(profiles(texts), "profiles")
    # A repeated row would count its shingles twice.
    own = written(rarest(texts.filter("wide").groupBy("node").agg(F.first("text").alias("text")), percent), "own")
    members = near.join(nodes.select("node", "bands"), "node").withColumn("id", F.xxhash64("node")).join(own, "id", "left").select("bucket", "node", "n", "bands", F.coalesce("own", F.lit(0)).alias("own"), "often", "rare", "keys", "m")
    members = written(members.filter((F.col("m") <= WIDE) | (100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))).drop("m"), "members")

    def bounded(own, ox):
        room = F.least(F.col("n") - own, F.col("nx") - ox)
        least = F.greatest(F.col("n") + ox, F.col("nx") + own)
        return (F.col("label") != F.col("lx")) & (100 * room >= percent * least)

    pair = (F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))

    def pairs_of(m: DataFrame, one: DataFrame, more=F.lit(True)) -> DataFrame:
        # Own shingles were counted among wide classes, which alone have rare ones; they say nothing of others.
        wide = F.col("rare").isNotNull() & F.col("rx").isNotNull()
        fits = bounded(*(F.when(wide, F.col(c)).otherwise(0) for c in ("own", "ox")))
        fits = fits & F.coalesce(more, F.lit(True))
        # A pair comes from the first bucket that both share.
        fits = fits & F.coalesce(F.arrays_overlap("rare", "rx"), F.lit(True))
        fits = fits & (F.col("bucket") == F.array_min(F.array_intersect("bands", "bx")))
        return m.join(one, "bucket").filter(fits).select(*pair).distinct()

    def pairs_at_shingles(m: DataFrame) -> DataFrame:
        """Pairs of wide classes that share a bucket and one of their rarest shingles that at most WIDE classes have."""
        each = m.filter("keys IS NOT NULL").dropDuplicates(["node"]).select("node", "label", "n", "own", "bands", F.explode("keys").alias("key"))
        one = each.select("key", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("own").alias("ox"), F.col("bands").alias("bx"))
        fits = (F.col("node") < F.col("x")) & bounded(F.col("own"), F.col("ox")) & F.arrays_overlap("bands", "bx")
        return each.join(one, "key").filter(fits).select(*pair).distinct()

    def links_of(pairs: DataFrame) -> DataFrame:
        with small_batches(docs.sparkSession):
            return written(check(written(possible(pairs, profile, percent), "possible"), texts, percent), "links")

    side = lambda d: d.select("bucket", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("own").alias("ox"), F.col("bands").alias("bx"), F.col("rare").alias("rx"), F.col("often").alias("fx"))
    single = members.withColumn("label", F.col("node"))
    rank = Window.partitionBy("bucket").orderBy(F.col("own") / F.col("n"), F.xxhash64("node"))
    centres = single.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= CENTRES)
    tested = written(pairs_of(single, side(centres)), "pairs")
    edges = links_of(tested)
    labels = components(edges)

    m = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = m.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.bool_or(F.col("rare").isNull()).alias("mixed"))
    split = written(split.filter("lo <> hi").drop("lo", "hi"), "split")
    m = written(m.join(split, "bucket"), "open")
    shared = pairs_at_shingles(m)
    # The rest share frequent shingles only; a bucket with a class that isn't wide has at most WIDE.
    size = F.greatest(100 * F.col("least"), percent * F.col("n"))
    m = m.filter(F.col("mixed") | (10000 * F.col("often") >= percent * (100 * (F.col("n") - F.col("often")) + size))).drop("least", "mixed")
    both = F.least(F.when(F.col("fx").isNotNull(), F.col("often")), F.when(F.col("often").isNotNull(), F.col("fx")))
    enough = 100 * both >= percent * (F.col("n") + F.col("nx") - both)
    most = m.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "label")).alias("top"))
    rest = m.join(most.select("bucket", F.col("top.label").alias("big")), "bucket").filter("label <> big")
    pairs = pairs_of(m, side(rest), enough).unionByName(shared).distinct()
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    more = links_of(pairs)
    if not more.isEmpty():
        edges = edges.unionByName(more)
        labels = components(edges)

    # Name components by their first row; only classes with company have a row here.
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("rep").alias("c"), F.sum("copies").alias("size")).filter("size > 1").select("label", "c")
    moved = named.join(names, "label").select("node", F.col("c.doc_id").alias("id"), F.col("c.tk").alias("tk"))
    return sk, written(moved, "groups")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    sk, named = groups(docs, percent)
    out = sk.select("doc_id", "n", "node").join(named.select("node", "id", F.lit(True).alias("grouped")), "node", "left")
    component = F.when(F.col("grouped"), F.col("id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group, columns unchanged.

    It is the row with the smallest id (nulls last), then the smallest hash of
    the text; of rows with that id and text, the one with the smallest hash of
    all columns.  Rows are judged one by one: another text under the same id, or
    a row without words, isn't touched.
    """
    sk, named = groups(docs, percent)
    first = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tk") == F.col("first_tk"))
    # An id and a text name one class, so this is one row for each.
    marks = sk.join(named.withColumnRenamed("tk", "first_tk"), "node").select(F.col("doc_id").alias("_id"), F.col("tk").alias("_mtk"), first.alias("_first")).distinct()
    # The columns go through as one, so that their names can't clash.
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(row.alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64(text_of("text")).alias("_tk"))
    rows = rows.join(marks, rows["_d"].eqNullSafe(marks["_id"]) & (rows["_tk"] == marks["_mtk"]), "left")
    one = rows.filter("_first").groupBy("_d", "_tk").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    both = rows.filter("_first IS NULL").select("_row").unionByName(one)
    return both.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
