import random
import re

import numpy as np
import pytest

from keyloom.llm import minhash


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", " \t\n", "one", "One", "one two three", "ONE two  three", "É x y z q", "é x y z q"]
    for base in range(6):
        text = [r.choice(words) for _ in range(r.randint(30, 300))]
        for _ in range(r.choice([1, 3, 70])):
            copy = list(text)
            for _ in range(r.randint(0, 1 + len(text) // 25)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
        out += [" ".join(text)] * base
    return list(enumerate(out))


@pytest.mark.parametrize("wide", [2, 32])
def test_against_all_pairs(spark, monkeypatch, wide):
    monkeypatch.setattr(minhash, "WIDE", wide)
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame([(d, t, b"") for d, t in rows], "doc_id long, text string, bands binary")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def straddling():
    """Texts with a common template, and copies whose template part alone is edited: often one of two is in a wide bucket."""
    r = random.Random(23)
    word = lambda: f"w{r.randrange(10**6)}"
    template = [word() for _ in range(140)]
    out = [" ".join(template + [word() for _ in range(70)]) for _ in range(150)]
    for _ in range(40):
        text = template + [word() for _ in range(70)]
        copy = list(text)
        for i in (25, 70, 115):
            copy[i] = word()
        out += [" ".join(text), " ".join(copy)]
    return list(enumerate(out))


@pytest.mark.parametrize("wide", [8, 32])
def test_links_between_wide_and_other_classes(spark, monkeypatch, wide):
    monkeypatch.setattr(minhash, "WIDE", wide)
    rows = straddling()
    sizes = {}
    buckets = [minhash.bands(minhash.signature(minhash.shingles(t))).tolist() for _, t in rows]
    for b in buckets:
        for x in b:
            sizes[x] = sizes.get(x, 0) + 1
    is_wide = [max(sizes[x] for x in b) > wide for b in buckets]
    assert any(is_wide[i] != is_wide[i + 1] for i in range(150, 230, 2))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def edited_copies(n):
    """Copies of one text: three of four have one to three edits and link, the rest have four or five and mostly don't.  Edits stand in several copies."""
    r = random.Random(31)
    text = [f"w{r.randrange(10**6)}" for _ in range(150)]
    out = []
    for i in range(n):
        copy = list(text)
        for j in r.sample(range(150), r.randint(4, 5) if i % 4 == 0 else r.randint(1, 3)):
            copy[j] = f"e{j}x{r.randrange(n // 80)}"
        out.append(" ".join(copy))
    return list(enumerate(out))


def test_few_pairs_between_edited_copies(spark, monkeypatch):
    made, write = [], minhash.written

    def counted(df, name):
        out = write(df, name)
        if name == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", counted)
    rows = edited_copies(400)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, 80)
    # Bounds on own and rarest shingles alone left 44,114.
    assert sum(made) < 20_000


def test_sample_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = minhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "q"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in minhash.near_duplicates(df).collect())
    assert got == [("5", 2, "5"), ("5", 2, "5"), ("7", 1, "7"), ("None", 0, "None"), ("None", 2, "5")]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.deduplicate(df.filter("doc_id IS NOT NULL")).columns == ["doc_id", "text"]
    assert minhash.deduplicate(df.limit(0)).count() == 0


def test_deduplicate_judges_rows(spark):
    a, b, u = "one two three four five six", "b1 b2 b3 b4 b5 b6", "u1 u2 u3 u4 u5 u6"
    rows = [(3, a, "x"), (5, a, "y"), (5, u, "z"), (7, b, "1"), (7, b, "2"), (None, a, "n"), (None, a, "n"), (None, u + " u7", "w"), (8, None, "e"), (8, None, "e"), (9, " ", "e"), (None, b, "q")]
    got = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, _first_ string"))
    assert got.columns == ["doc_id", "text", "_first_"]
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(3, a), (5, u), (7, b), (None, u + " u7"), (8, None), (8, None), (9, " ")], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in minhash.deduplicate(spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")).collect()), key=str) == [(None, b), (None, a)]


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**64, 2000, np.uint64)
    b = np.concatenate([a[:1500], r.integers(0, 2**64, 500, np.uint64)])
    same = (minhash.signature(np.unique(a)) == minhash.signature(np.unique(b))).mean()
    assert abs(same - 0.6) < 0.15
    small = minhash.signature(a[:3])
    assert len(small) == minhash.BINS and (small != minhash._EMPTY).all()


def test_profiles_never_exclude_a_link():
    r = np.random.default_rng(4)
    for n in (3, 40, 480, 520, 3990, 4100):
        a = np.unique(r.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.93)], r.integers(0, 2**64, n // 30, np.uint64)]))
        assert not minhash.linked(a, b, 85) or minhash.may_link(minhash._profile(a), minhash._profile(b), 85)
        assert minhash.may_link(minhash._profile(a), minhash._profile(a), 100)
