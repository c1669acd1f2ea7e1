"""Find benchmark items in documents by q-gram lemma filtering and banded alignment.

Texts are compared in lower case with each run of white space as one space.
An item of m characters may lie in a document with up to e = ``edits`` * m edits
(less where the lemma would say nothing).  By the q-gram lemma such a place
shares at least m - q + 1 - q * e of the item's q-grams, and their diagonals
(document position less item position) spread over at most e.  So hits are
counted in bands of diagonals, each 2 * (e + 1) wide and overlapping its
neighbour by half: some band holds them all.  Bands that reach the bound are
verified by a banded alignment.

Documents are read in one pass without a shuffle.  Items are sent to every task
in blocks of at most ``BLOCK_CHARS`` characters, one pass for each block, so
what is sent has a bound whatever the benchmark's size.

Document or item text null or empty: no match.  An item with fewer than q
characters matches only a document that equals it.  Equal items each report
their matches; repeated documents each report theirs; a null id stays null.
Extra columns are ignored.  Empty tables: no match, and every document is clean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Q, EDITS, BLOCK_CHARS = 10, 0.06, 16_000_000
_K = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit number for each q-gram, mixed so that its high bits can be used."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, have, h = codes.astype(np.uint64) * _K, 1, None
    out, done = np.zeros(n, np.uint64), 0
    while True:  # q-gram from its binary parts
        if q & have:
            out = out * _K ** np.uint64(1 + have) + power[done : done + n]
            done += have
        if done == q:
            break
        h = power[: len(power) - have] * _K ** np.uint64(1 + 2 * have) + power[have:]
        power, have = h, have * 2
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def budget(m: int, edits: float, q: int = Q) -> int:
    """The most edits, up to the share asked for, with which the lemma still requires a shared q-gram."""
    return max(0, min(int(edits * m), (m - q) // q))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Least edits of the item against a part of the text that starts on a diagonal low..high, and where that part ends."""
    width = high - low + 1
    steps = np.arange(width)
    at = np.arange(low, high + 1)
    padded = np.full(len(item) + width + 1, 0xFFFFFFFF, np.uint32)  # no character
    a, b = max(0, low), min(len(text), high + len(item) + 1)
    if b > a:
        padded[a - low : b - low] = text[a:b]
    v = np.where((at >= 0) & (at <= len(text)), 0, 1 << 20)
    for i, c in enumerate(item):
        diagonal = v + (padded[i : i + width] != c)
        below = np.append(v[1:], 1 << 20) + 1
        v = np.minimum(diagonal, below)
        v = np.minimum.accumulate(v - steps) + steps
    ends = at + len(item)
    v = np.where((ends >= 0) & (ends <= len(text)), v, 1 << 20)
    k = int(v.argmin())
    return int(v[k]), int(ends[k])


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, edits: float = EDITS):
        self.q = q
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.codes = [_codes(t) for t in self.texts]
        m = np.array([len(c) for c in self.codes], np.int64)
        self.e = np.array([budget(int(x), edits, q) for x in m], np.int64)
        self.need = m - q + 1 - q * self.e
        self.longest = 2 * int(m.max(initial=0)) + 2  # a diagonal plus this, and its band less one, is never below zero
        self.short: dict[str, list[int]] = {}
        keys, owner, place = [], [], []
        for t, c in enumerate(self.codes):
            if len(c) >= q:
                g = grams(c, q)
                keys.append(g)
                owner.append(np.full(len(g), t))
                place.append(np.arange(len(g)))
            elif len(c):
                self.short.setdefault(self.texts[t], []).append(t)
        k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(k, kind="stable")
        self.owner = np.concatenate(owner)[order] if keys else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if keys else np.zeros(0, np.int64)
        self.keys, self.first = np.unique(k[order], return_index=True)
        self.last = np.append(self.first[1:], len(k))
        self.bits = max(16, int(len(self.keys)).bit_length() + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True

    def find(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item id, edits, end in the normalised text) of the best place of each item that the text holds."""
        t = normal(text)
        found = {k: (0, len(t)) for k in self.short.get(t, ())}
        codes = _codes(t)
        g = grams(codes, self.q)
        at = np.flatnonzero(self.seen[g >> np.uint64(64 - self.bits)]) if len(g) and len(self.keys) else np.zeros(0, np.int64)
        if len(at):
            slot = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
            real = self.keys[slot] == g[at]
            at, slot = at[real], slot[real]
        if len(at):
            for item, low, high in self._bands(at, slot):
                if found.get(item, (1, 0))[0] == 0:
                    continue
                e = int(self.e[item])
                low, high = low - e, high + e
                start = t.find(self.texts[item], max(0, low), max(0, high) + len(self.codes[item]))
                edits, end = (0, start + len(self.codes[item])) if start >= 0 else align(self.codes[item], codes, low, high)
                if edits <= e and (item not in found or edits < found[item][0]):
                    found[item] = (edits, end)
        return [(self.ids[k], *found[k]) for k in sorted(found)]

    def _bands(self, at: np.ndarray, slot: np.ndarray):
        """(item, lowest and highest diagonal) of bands with enough shared q-grams."""
        n = self.last[slot] - self.first[slot]
        # Hits of a part of the positions at a time: their number has no bound beforehand.
        cuts = np.searchsorted(np.cumsum(n), np.arange(4_000_000, int(n.sum()) + 4_000_000, 4_000_000))
        parts, begin = [], 0
        for end in [*cuts, len(n)]:
            end = min(end + 1, len(n))
            if end > begin:
                k = n[begin:end]
                hit = np.repeat(self.first[slot[begin:end]] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(int(k.sum()))
                item = self.owner[hit]
                band = (np.repeat(at[begin:end], k) - self.place[hit] + self.longest) // (self.e[item] + 1)
                both = np.concatenate([(item << 40) | band, (item << 40) | (band - 1)])
                parts.append(np.unique(both, return_counts=True))
                begin = end
        keys = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        if len(parts) > 1:
            keys, inverse = np.unique(keys, return_inverse=True)
            counts = np.bincount(inverse, counts).astype(np.int64)
        item = keys >> 40
        ok = counts >= self.need[item]
        for i, key in zip(item[ok].tolist(), keys[ok].tolist(), strict=True):
            w = int(self.e[i]) + 1
            low = (key & ((1 << 40) - 1)) * w - self.longest
            yield i, low, low + 2 * w - 1


def blocks(benchmark: DataFrame, id_col: str, most: int = BLOCK_CHARS):
    """The items in blocks of at most ``most`` characters (or of one item)."""
    out, size = [], 0
    for r in benchmark.select(id_col, "text").toLocalIterator():
        t = normal(r["text"])
        if not t:
            continue
        if out and size + len(t) > most:
            yield out
            out, size = [], 0
        out.append((r[id_col], t))
        size += len(t)
    if out:
        yield out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", edits: float = EDITS, q: int = Q) -> DataFrame:
    """(doc_id, item_id, edits, end): the best place of every item in every document that holds it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, edits int, end long"
    out = None
    for block in blocks(benchmark, id_col):

        def run(batches, block=block):
            index = Index(block, q, edits)
            for pdf in batches:
                rows = [(d, *x) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) if t for x in index.find(t)]
                cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                made = pd.DataFrame({"doc_id": pd.Series(cols[0], dtype=pdf["doc_id"].dtype), "item_id": pd.Series(cols[1], dtype=object), "edits": pd.Series(cols[2], dtype="int32"), "end": pd.Series(cols[3], dtype="int64")})
                yield made

        part = docs.select("doc_id", "text").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, q: int = Q) -> DataFrame:
    """The documents without any benchmark item, columns unchanged: one pass, nothing is shuffled."""
    out = docs
    for block in blocks(benchmark, "item_id"):

        def run(batches, block=block):
            index = Index(block, q, edits)
            for pdf in batches:
                yield pdf[[not (t and index.find(t)) for t in pdf["text"]]]

        out = out.mapInPandas(run, docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find(docs, items).select("doc_id", "item_id", "edits", F.col("end").alias("end_at"))
