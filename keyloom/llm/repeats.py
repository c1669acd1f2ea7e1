"""Remove every byte that a string of 400 bytes with another occurrence covers.

Sorting all suffixes would exchange hundreds of bytes for every byte of input,
so suffixes are sorted at anchors only, and anchors that can't matter go first.

1. Anchors are the starts of closed syncmers of ``PIECE`` bytes (minimal inner
   ``GRAM``-gram at an edge).  They depend on their own bytes alone, and every
   400 bytes hold at least one, so equal 400-byte windows have their first
   anchor at the same offset.  Equal texts become one class; whole classes with
   two members and 400 bytes are repeats.
2. Anchors whose piece occurs once in the corpus can't be the first anchor of a
   repeated window.
3. For the others each task sorts the suffixes (what follows the piece, up to
   the end of the last window) together with the bytes before them, front-codes
   the sorted run and sends a part of it to each range of keys.
4. A range merges its runs with a loser tree that knows how long a prefix each
   loser shares with the last winner and never compares it again.  The common
   prefixes that come out tell which suffixes agree far enough for a window
   that starts ``o`` bytes before the anchor; among these, equal bytes before
   the anchor mean equal windows.  Each ``o`` costs one pass over the range.
5. A piece with more than ``HOT`` occurrences would make one range as large as
   the group.  Its windows are counted one by one instead, by a 64-bit hash, with
   partial sums before the shuffle.  Both ways give the same answer.

Beside the bytes, ``n_shared_words`` counts the words inside passages of
``SHARED`` words that stand anywhere else too, white space aside: such a passage
may have fewer than 400 bytes, which stay.  Its windows are found the same way
from anchors among the words, and counted piece by piece, or as in 5 where the
piece is hot.

Pieces and counted windows are compared by 64-bit hashes, texts by MD5.

Text null or empty: no bytes, no spans.  Texts of fewer than 400 bytes keep all.
Repeated rows are copies of each other.  Null ids are rows like others.  Empty
table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import discard, small_batches, text_of, written

LENGTH, PIECE, GRAM, HOT = 400, 208, 16, 500
SHARED, WORD_PIECE, WORD_GRAM = 50, 26, 2
BLOCK, RUN_BYTES = 1 << 19, 12 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


_SPACE = np.isin(np.arange(256), list(b"\x20\t\n\x0b\x0c\r"))


def by_byte(data: bytes) -> np.ndarray:
    return _mix((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * _A)


def by_word(data: bytes, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and how many words stand before each of the ends (which are white space or the end of data)."""
    codes = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[codes]
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    before = np.searchsorted(first, len(codes) if ends is None else ends)
    if not len(first):
        return np.zeros(0, np.uint64), before
    place = np.arange(len(codes)) - np.repeat(np.append(0, first), np.diff(np.concatenate([[0], first, [len(codes)]])))
    weight = np.multiply.accumulate(np.full(int(place.max()) + 1, _B | np.uint64(1)))
    value = np.where(inside, (codes.astype(np.uint64) + np.uint64(1)) * _A, np.uint64(0))
    return _mix(np.add.reduceat(value * weight[place], first)), before


class Hashes:
    """Hashes of the strings of some lengths at every place; lengths are sums of powers of two."""

    def __init__(self, base: np.ndarray):
        self.of = {1: base}

    def power(self, size: int) -> np.ndarray:
        if size not in self.of:
            half = self.power(size // 2)
            self.of[size] = self.join(half, half, size // 2)
        return self.of[size]

    def join(self, a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
        n = max(0, min(len(a), len(b) - at))
        return _mix(a[:n] * _A + b[at : at + n])

    def size(self, n: int) -> np.ndarray:
        """Of n places: two overlapping powers of two hold them all."""
        half = 1 << (n - 1).bit_length() - 1
        return self.power(n) if n & (n - 1) == 0 else self.join(self.power(half), self.power(half), n - half)


def _low(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def leading(h: Hashes, ends: np.ndarray, piece: int, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text (they follow each other and end at ``ends``): piece hash, position and gap to the anchor before, of the anchors that can lead a window; and where each text's begin."""
    g, width = h.power(gram), piece - gram + 1
    hashes = h.size(piece).view(np.int64)
    if not len(hashes):
        return hashes[:0], np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(ends) + 1, np.int64)
    low = _low(g, width)
    at = np.flatnonzero((low == g[: len(low)]) | (low == g[width - 1 :][: len(low)]))
    text = np.searchsorted(ends, at, "right")
    ok = at + piece <= ends[text]
    at, text = at[ok], text[ok]
    size = np.diff(ends, prepend=0)
    pos = at - (ends - size)[text]
    new = np.diff(text, prepend=-1) > 0
    gap = np.where(new, pos + 1, np.diff(pos, prepend=0))
    use = pos + window - size[text] < gap
    return hashes[at[use]], pos[use].astype(np.int32), gap[use].astype(np.int32), np.searchsorted(text[use], np.arange(len(ends) + 1))


def anchors(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each text its anchors among bytes and, with positions below zero, among words; and its number of words."""
    data = b" ".join(texts) + b" "
    stops = np.cumsum([len(t) + 1 for t in texts])
    words, ends = by_word(data, stops)
    n_words = np.diff(ends, prepend=0)
    wp, wpos, wgap, wcut = leading(Hashes(words), ends, WORD_PIECE, WORD_GRAM, SHARED)
    long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    bp, bpos, bgap, bcut = leading(Hashes(by_byte(b"".join(texts[i] for i in long))), np.cumsum([len(texts[i]) for i in long]), PIECE, GRAM, LENGTH) if long else (wp[:0], wpos[:0], wgap[:0], np.zeros(1, np.int64))
    row = dict(zip(long, range(len(long)), strict=True))
    out = []
    for i in range(len(texts)):
        w = slice(wcut[i], wcut[i + 1])
        b = slice(bcut[row[i]], bcut[row[i] + 1]) if i in row else slice(0, 0)
        out.append((np.concatenate([bp[b], wp[w]]), np.concatenate([bpos[b], -1 - wpos[w]]), np.concatenate([bgap[b], wgap[w]])))
    return out, n_words


def _blocks(texts: list[bytes]):
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def outlines(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, n, words, sha, piece, pos, gap) for every document; a position below zero is one among words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            texts = [bytes(t) for t in pdf["text"]]
            parts = [anchors(part) for part in _blocks(texts)]
            got = [a for part, _ in parts for a in part]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "tk": [hashlib.md5(t).digest() for t in texts],
                    "n": np.array([len(t) for t in texts], np.int64),
                    "words": np.concatenate([w for _, w in parts]) if parts else np.zeros(0, np.int64),
                    "sha": [hashlib.sha256(t).hexdigest() for t in texts],
                    "piece": [a[0] for a in got],
                    "pos": [a[1] for a in got],
                    "gap": [a[2] for a in got],
                }
            )

    return docs.select("doc_id", F.encode(text_of("text"), "UTF-8").alias("text")).mapInPandas(run, f"doc_id {kind}, tk binary, n long, words long, sha string, piece array<long>, pos array<int>, gap array<int>")


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, given that ``start`` bytes agree."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (diff.bit_length() + 7) // 8


def pack(records: list[tuple]) -> bytes:
    """A sorted run of (key, left, tk, pos, gap, least), front-coded: what a key shares with the one before isn't stored."""
    tails, lefts, lk, ll = [], [], [], []
    key = left = b""
    for r in records:
        k = common(key, r[0])
        m = common(left, r[1])
        lk.append(k)
        ll.append(m)
        tails.append(r[0][k:])
        lefts.append(r[1][m:])
        key, left = r[0], r[1]
    sizes = lambda x: np.array([len(t) for t in x], np.uint16).tobytes()
    numbers = np.array([r[3:] for r in records], np.int32).reshape(len(records), 3)
    body = (np.array(lk, np.uint16).tobytes(), sizes(tails), b"".join(tails), np.array(ll, np.uint16).tobytes(), sizes(lefts), b"".join(lefts), b"".join(r[2] for r in records), numbers.tobytes())
    return zlib.compress(pickle.dumps(body), 1)


def unpack(run: bytes) -> list[tuple]:
    """(common prefix with the key before, key, left, tk, pos, gap, least) of a run, in order."""
    lk, nk, tails, ll, nl, lefts, tks, numbers = pickle.loads(zlib.decompress(run))
    lk, nk, ll, nl = (np.frombuffer(x, np.uint16).tolist() for x in (lk, nk, ll, nl))
    numbers = np.frombuffer(numbers, np.int32).reshape(-1, 3).tolist()
    out, key, left, a, b = [], b"", b"", 0, 0
    for i, k in enumerate(lk):
        key = key[:k] + tails[a : a + nk[i]]
        left = left[: ll[i]] + lefts[b : b + nl[i]]
        a, b = a + nk[i], b + nl[i]
        out.append((k, key, left, tks[16 * i : 16 * i + 16], *numbers[i]))
    return out


def merge(runs: list[list[tuple]]):
    """All records of sorted runs in order, each with the length of the prefix it shares with the one before.

    A tree of losers: a stream waiting at a node knows the prefix its key shares
    with the last winner.  Of two streams the one that shares more is smaller;
    only on a tie are bytes compared, from the known prefix on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    at = [0] * size
    keys: list[bytes | None] = [r[0][1] if r else None for r in runs] + [None] * (size - len(runs))
    known = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = keys[a], keys[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        d = common(x, y, known[a])
        if d == len(x) or (d < len(y) and x[d] < y[d]):
            known[b] = d
            return a, b
        known[a] = d
        return b, a

    losers = [0] * size
    row = list(range(size))
    level = size
    while len(row) > 1:
        level //= 2
        nxt = []
        for i in range(0, len(row), 2):
            w, lost = play(row[i], row[i + 1])
            losers[level + i // 2] = lost
            nxt.append(w)
        row = nxt
    w = row[0]
    while keys[w] is not None:
        r = runs[w][at[w]]
        yield known[w], *r[1:]
        at[w] += 1
        if at[w] < len(runs[w]):
            known[w], keys[w] = runs[w][at[w]][:2]
        else:
            keys[w] = None
        node = (size + w) // 2
        while node:
            w, losers[node] = play(w, losers[node])
            node //= 2


def repeated(merged: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, first o, last o) of all stretches of repeated windows, from the merged order and its common prefixes."""
    n = len(merged)
    follow = LENGTH - PIECE
    prefix = np.array([r[0] for r in merged], np.int64) - 8  # without the piece's hash
    gap = np.array([r[5] for r in merged], np.int64)
    least = np.array([r[6] for r in merged], np.int64)
    width = int(gap.max(initial=0))
    left = np.zeros((n, max(1, width)), np.uint8)
    for i, r in enumerate(merged):
        left[i, : len(r[2])] = np.frombuffer(r[2], np.uint8)
    same = np.zeros((n, width + 2), bool)
    h = np.zeros(n, np.uint64)
    for o in range(width):
        use = np.flatnonzero((least <= o) & (o < gap))
        if len(use) > 1:
            group = np.cumsum(prefix < follow - o).astype(np.uint64)
            key = _mix(group[use] * _A + h[use])
            order = np.argsort(key)
            k = key[order]
            eq = k[1:] == k[:-1]
            hit = np.zeros(len(use), bool)
            hit[order[1:][eq]] = True
            hit[order[:-1][eq]] = True
            same[use[hit], o + 1] = True
        h = _mix(h * _B + left[:, o] + np.uint64(1))
    step = np.diff(same.astype(np.int8), axis=1)
    rec, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return rec, first, last - 1


def windows_before(text: bytes, pos: int, gap: int, least: int) -> tuple[bytes, bytes]:
    """What follows the piece as far as a window reaches, and what stands before it, nearest byte first."""
    end = min(len(text), pos + LENGTH - least)
    return text[pos + PIECE : end], text[pos - gap + 1 : pos][::-1]


def runs_of(joined: DataFrame, ranges: int) -> DataFrame:
    """Rows of four kinds: (range, run), (range, tk, pos, least, windows) of words, the same without range of hot pieces, (tk, text) of texts still needed."""

    def run(batches):
        records: list[tuple] = []
        size = 0

        def rows(**columns):
            return pd.DataFrame({c: columns.get(c) for c in ("range", "run", "tk", "pos", "least", "windows", "text")})

        def flush():
            records.sort()
            begin, out = 0, []
            parts = [(int.from_bytes(r[0][:8], "big") * ranges) >> 64 for r in records]
            for i in range(1, len(records) + 1):
                if i == len(records) or parts[i] != parts[begin]:
                    out.append((parts[begin], pack(records[begin:i])))
                    begin = i
            records.clear()
            return rows(range=[x for x, _ in out], run=[x for _, x in out])

        for pdf in batches:
            counted, texts = [], []
            for tk, text, copies, *cand in zip(*(pdf[c] for c in ("tk", "text", "copies", "piece", "pos", "gap", "hot")), strict=True):
                text, tk, hashes, of_words = bytes(text), bytes(tk), None, None
                if copies == 1:
                    texts.append((tk, text))
                for piece, pos, gap, is_hot in zip(*(c.tolist() for c in cand), strict=True):
                    if pos < 0:
                        of_words = Hashes(by_word(text)[0]).size(SHARED).view(np.int64) if of_words is None else of_words
                        last = min(-1 - pos, len(of_words) - 1)
                        counted.append((None if is_hot else piece % ranges, tk, pos, -1 - pos - last, of_words[-pos - gap : last + 1][::-1]))
                        continue
                    least = max(0, pos + LENGTH - len(text))
                    if is_hot:
                        hashes = Hashes(by_byte(text)).size(LENGTH).view(np.int64) if hashes is None else hashes
                        counted.append((None, tk, pos, least, hashes[pos - gap + 1 : pos - least + 1][::-1]))
                        continue
                    right, left = windows_before(text, pos, gap, least)
                    records.append(((piece & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big") + right, left, tk, pos, gap, least))
                    size += len(right) + len(left) + 200
                if size > RUN_BYTES:
                    yield flush()
                    size = 0
            if counted:
                cols = list(zip(*counted, strict=True))
                yield rows(range=pd.array(cols[0], "Int32"), tk=cols[1], pos=cols[2], least=cols[3], windows=list(cols[4]))
            if texts:
                yield rows(tk=[x for x, _ in texts], text=[x for _, x in texts])
        if records:
            yield flush()

    return joined.select("tk", "text", "copies", "cand.piece", "cand.pos", "cand.gap", "cand.hot").mapInPandas(run, "range int, run binary, tk binary, pos int, least int, windows array<long>, text binary")


def merged_spans(runs: DataFrame) -> DataFrame:
    """(tk, start, end) of repeated stretches, one range at a time."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = list(merge([unpack(r) for r in pdf["run"]]))
        rec, first, last = repeated(merged)
        pos = np.array([r[4] for r in merged], np.int64)[rec]
        return pd.DataFrame({"tk": [merged[i][3] for i in rec], "start": pos - last, "end": pos - first + LENGTH})

    return runs.groupBy("range").applyInPandas(one, "tk binary, start long, end long")


def word_spans(windows: DataFrame) -> DataFrame:
    """The same for words, one range of pieces at a time; spans of words start below zero, at -1 - word."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.array([len(w) for w in pdf["windows"]], np.int64)
        _, which, m = np.unique(np.concatenate(list(pdf["windows"])), return_inverse=True, return_counts=True)
        ends = np.cumsum(n)
        hit = np.insert(m[which] > 1, ends, False)  # a gap behind each row's windows
        step = np.diff(np.concatenate([[False], hit]).astype(np.int8))
        first, after = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        row = np.searchsorted(ends + np.arange(1, len(n) + 1), first, "right")
        begin = (ends - n + np.arange(len(n)))[row]
        top = (-1 - pdf["pos"].to_numpy(np.int64) - pdf["least"].to_numpy(np.int64))[row]  # window i starts at word top - i
        return pd.DataFrame({"tk": pdf["tk"].to_numpy()[row], "start": -1 - (top - (after - 1 - begin)), "end": top - (first - begin) + SHARED})

    return windows.groupBy("range").applyInPandas(one, "tk binary, start long, end long")


def counted_spans(windows: DataFrame) -> DataFrame:
    """Both for hot pieces, by counting each window."""
    each = windows.select("tk", "pos", "least", F.posexplode("windows").alias("i", "window"))
    # Written, so that the join has exchanges of its own and a window that many texts hold can be split.
    twice = written(each.groupBy("window").agg(F.count("*").alias("m")).filter("m > 1").select("window"), "windows")
    of_word = F.col("pos") < 0
    start = F.when(of_word, -1 - F.col("pos")).otherwise(F.col("pos")) - F.col("least") - F.col("i")
    hit = each.join(twice, "window").select("tk", of_word.alias("of_word"), start.cast("long").alias("start"))
    return hit.select("tk", F.when(F.col("of_word"), -1 - F.col("start")).otherwise(F.col("start")).alias("start"), (F.col("start") + F.when(F.col("of_word"), SHARED).otherwise(LENGTH)).alias("end"))


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans joined where they meet or overlap."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(tk, n_removed, n_spans, kept_sha, n_shared_words) of the texts with spans."""
    lists = spans.groupBy("tk").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches):
        for pdf in batches:
            rows = []
            for text, starts, ends in zip(pdf["text"], pdf["start"], pdf["end"], strict=True):
                text, at, h = bytes(text), 0, hashlib.sha256()
                both = sorted(zip(starts.tolist(), ends.tolist(), strict=True))
                gone = covered([x for x in both if x[0] >= 0])
                for start, end in gone:
                    h.update(text[at:start])
                    at = end
                h.update(text[at:])
                shared = covered(sorted((-1 - a, b) for a, b in both if a < 0))
                rows.append((sum(b - a for a, b in gone), len(gone), h.hexdigest(), sum(b - a for a, b in shared)))
            yield pd.DataFrame({"tk": pdf["tk"], **{c: [r[i] for r in rows] for i, c in enumerate(("n_removed", "n_spans", "kept_sha", "n_shared_words"))}})

    return texts.join(lists, "tk").select("tk", "text", "spans.start", "spans.end").mapInPandas(run, "tk binary, n_removed long, n_spans long, kept_sha string, n_shared_words long")


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, n_shared_words) for every document."""
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark):
        a = written(outlines(docs.select("doc_id", "text")), "outlines")
    ids = written(a.select("doc_id", "tk", "n", "sha"), "ids")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("rep")
    first = F.first(F.struct("piece", "pos", "gap")).alias("x")
    classes = written(a.groupBy("tk").agg(F.count("*").alias("copies"), rep, F.first("n").alias("n"), F.first("words").alias("words"), first), "classes")
    discard(a)
    each = classes.select("tk", F.inline(F.arrays_zip("x.piece", "x.pos", "x.gap")))
    counts = each.groupBy("piece").agg(F.count("*").alias("m")).filter("m > 1").select("piece", (F.col("m") > hot).alias("hot"))
    counts = written(counts, "pieces")  # as with the windows, so that the join below can be split
    cand = each.join(counts, "piece").groupBy("tk").agg(F.collect_list(F.struct("piece", "pos", "gap", "hot")).alias("cand"))
    cand = cand.join(classes.select("tk", "copies", F.col("rep.doc_id").alias("rep_id")), "tk")
    texts = docs.select("doc_id", F.encode(text_of("text"), "UTF-8").alias("text")).withColumn("mine", F.unhex(F.md5("text")))
    joined = texts.join(cand, texts["doc_id"].eqNullSafe(cand["rep_id"]) & (texts["mine"] == cand["tk"]))
    with small_batches(spark):
        work = written(runs_of(joined, ranges), "runs")
    spans = merged_spans(work.filter("run IS NOT NULL").select("range", "run"))
    spans = spans.unionByName(word_spans(work.filter("range IS NOT NULL AND windows IS NOT NULL").select("range", "tk", "pos", "least", "windows")))
    spans = spans.unionByName(counted_spans(work.filter("range IS NULL AND windows IS NOT NULL").select("tk", "pos", "least", "windows")))
    some = kept(work.filter("text IS NOT NULL").select("tk", "text"), spans)
    long, many = F.col("n") >= LENGTH, F.col("words") >= SHARED
    none = hashlib.sha256(b"").hexdigest()
    number = lambda c, v: F.when(c, v).otherwise(0).cast("long")
    whole = classes.filter((F.col("copies") > 1) & (long | many)).select("tk", number(long, F.col("n")).alias("n_removed"), number(long, F.lit(1)).alias("n_spans"), F.when(long, none).alias("kept_sha"), number(many, F.col("words")).alias("n_shared_words"))
    whole = written(whole, "whole")
    discard(counts, classes)
    out = ids.join(some.unionByName(whole), "tk", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("doc_id", F.col("n").alias("n_bytes"), zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), zero("n_shared_words"))
    return out.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
