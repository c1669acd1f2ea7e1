import hashlib
import random
import re
from collections import Counter

import pytest

from keyloom.llm import repeats


def brute(texts, length=repeats.LENGTH):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def shared_words(texts, words=repeats.SHARED):
    split = [re.findall(rb"[^\x20\x09-\x0D]+", t) for t in texts]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for w in split:
        hit = set()
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i : i + words])] > 1:
                hit.update(range(i, i + words))
        out.append(len(hit))
    return out


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghé𝒳") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (60, 75, 90, 150, 400)]
    few = " ".join(r.choice("abcdefgh") for _ in range(70))  # over 50 words in fewer than 400 bytes
    docs = [few + " x y", "z  " + few.replace(" ", "\n"), "", "short", "a" * 399, "a" * 400, "b" * 1500, "ab" * 700, prose(900)]
    docs += [docs[-1], docs[-1], prose(30) + docs[-1][:800] + prose(3) + docs[-1][795:2000]]
    for i in range(60):
        parts = [prose(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            cut = r.randint(0, max(0, len(s) // 3))
            parts += [s[cut : len(s) - r.randint(0, 60)], prose(r.randint(0, 40))]
        docs.append("".join(parts))
    docs.append(shared[4] + "!" + shared[4])
    return docs


@pytest.mark.parametrize("hot", [0, 4, 500])
def test_against_all_windows(spark, hot):
    docs = corpus()
    rows = [(i if i != 7 else None, t, i) for i, t in enumerate(docs)] + [(900, None, 0)]
    got = {r["doc_id"]: tuple(r) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n long"), hot=hot).collect()}
    texts = [(t or "").encode() for _, t, _ in rows]
    want = brute(texts)
    words = shared_words(texts)
    assert len(got) == len(rows)
    for (d, _, _), w, n in zip(rows, want, words, strict=True):
        assert got[d] == (d, *w, n, w[0] - w[1]), d
    assert any(n and not w[1] for w, n in zip(want, words, strict=True)) and any(w[1] and not n for w, n in zip(want, words, strict=True))
    assert sum(w[1] for w in want) > 20000


def test_repeated_rows_and_empty_table(spark):
    text = "xyz " * 50 + "".join(chr(97 + i * i % 23) for i in range(500))
    rows = [(1, text), (1, text), (2, "q"), (2, text[5:] + "!")]
    got = sorted(tuple(r)[:5] for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted((d, *w) for (d, _), w in zip(rows, brute([t.encode() for _, t in rows]), strict=True))
    assert got == want
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_gives_order_and_common_prefixes():
    r = random.Random(5)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(500)]
    runs = []
    for k in range(7):
        part = sorted((x, bytes([i % 3]) * (i % 4), b"t" * 16, i, 1, 0) for i, x in enumerate(keys) if i % 7 == k)
        runs.append(repeats.unpack(repeats.pack(part)))
    out = list(repeats.merge([*runs, []]))
    assert [x[1] for x in out] == sorted(keys)
    assert [x[0] for x in out[1:]] == [repeats.common(a[1], b[1]) for a, b in zip(out, out[1:], strict=False)]
    assert len({x[4] for x in out}) == 500
