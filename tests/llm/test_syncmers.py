import base64
import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from keyloom.llm import syncmers


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, block string")


def test_edited_texts_and_likeness(spark):
    texts = {10: "alpha beta gamma " * 40, 20: "", 30: None, 40: "été ça va 𝒳𝒴𝒵 là", 55: "one " * 7 + "two three " * 50, 60: "q" * 5000, 70: "alpha beta gamma " * 40}
    got = {r["doc_id"]: r for r in syncmers.edited(frame(spark, texts.items()), blocks=3).collect()}
    ids = sorted(texts)
    whole = {r["doc_id"]: r["f"] for r in frame(spark, texts.items()).select("doc_id", syncmers.fingerprint(F.col("text")).alias("f")).collect()}
    edits = []
    for k, d in enumerate(ids):
        t, nxt = texts[d] or "", texts[ids[(k + 1) % len(ids)]] or ""
        m = len(t) // 4
        edits.append((d, t[: len(t) - m] + nxt[:m]))
    of_edit = {r["doc_id"]: r["f"] for r in frame(spark, edits).select("doc_id", syncmers.fingerprint(F.col("text")).alias("f")).collect()}
    for d, e in edits:
        r = got[d]
        assert r["n_chars"] == len(texts[d] or "")
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == whole[d] and r["edited_fingerprint"] == of_edit[d]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert got[10]["fingerprint"] == got[70]["fingerprint"] != got[40]["fingerprint"]
    assert got[20]["fingerprint"] == "" and got[20]["near_edited"] == 1.0 and got[20]["near_next"] == 1.0
    assert got[70]["near_next"] == 1.0  # the last one's next is the first


def brute(text):
    """(offset, hash) of every closed syncmer, from the definition."""
    h = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for i in range(len(text) - syncmers.K + 1):
        inner = [signed(h(text[j : j + syncmers.S])) for j in range(i, i + syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, h(text[i : i + syncmers.K]) >> 16))
    return out


def unpack(fingerprint):
    data, at, out = base64.b64decode(fingerprint), 0, []
    for i in range(0, len(data), 7):
        at += data[i + 6]
        out.append((at, int.from_bytes(data[i : i + 6], "big")))
    return out


def samples():
    r = random.Random(4)
    spaced = " ".join("".join(r.choice("abcdefghé𝒳") for _ in range(r.randint(1, 9))) for _ in range(300))
    solid = "".join(r.choice("天地玄黃宇宙洪荒日月盈昃辰宿列張") for _ in range(1500))
    return [spaced, solid, solid[: syncmers.K], solid[: syncmers.K - 1], "a" * 700, spaced[:199], spaced[:200], "x\ny" * 90, ""]


def test_all_anchors_are_the_closed_syncmers(spark):
    texts = samples()
    got = {r["doc_id"]: r["f"] for r in frame(spark, enumerate(texts)).select("doc_id", syncmers.fingerprint(F.col("text")).alias("f")).collect()}
    for i, t in enumerate(texts):
        want = brute(t) or ([(0, xxhash.xxh64_intdigest(t.encode(), 42) >> 16)] if t else [])
        assert unpack(got[i]) == want, i
        assert all(b[0] - a[0] <= syncmers.K - syncmers.S for a, b in zip(want, want[1:], strict=False))


def test_anchors_do_not_depend_on_what_stands_before(spark):
    for t in samples()[:2]:
        rows = frame(spark, [(1, t), (2, "q" + t), (3, t[:700] + "Z" + t[700:])])
        got = {r["doc_id"]: dict((h, at) for at, h in unpack(r["f"])) for r in rows.select("doc_id", syncmers.fingerprint(F.col("text")).alias("f")).collect()}
        assert set(got[1]) <= set(got[2]) and len(set(got[2]) - set(got[1])) <= 1
        assert all(got[2][h] == at + 1 for h, at in got[1].items())
        assert len(set(got[1]) & set(got[3])) > 0.9 * len(got[1])


def test_edits_and_likeness_against_brute_force(spark):
    texts = [*samples(), *samples()[:3]]
    rows = syncmers.edited(frame(spark, enumerate(texts)), blocks=4).collect()
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    of = lambda t: {h for _, h in brute(t)} or ({xxhash.xxh64_intdigest(t.encode(), 42) >> 16} if t else set())
    for r in rows:
        t, nxt = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert {h for _, h in unpack(r["edited_fingerprint"])} == of(e)
        assert abs(r["near_edited"] - near(of(t), of(e))) < 1e-12 and abs(r["near_next"] - near(of(t), of(nxt))) < 1e-12


def test_odd_tables(spark):
    assert syncmers.edited(frame(spark, [])).count() == 0
    one = syncmers.edited(frame(spark, [(1, "abcdefgh")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    rows = [(None, "x y z"), (None, "x y z"), (5, "same"), (5, "same"), (5, "other"), (5, None)]
    got = syncmers.edited(frame(spark, rows), blocks=4).collect()
    assert len(got) == len(rows)
    again = syncmers.edited(frame(spark, rows), blocks=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    hot = [(d, f"text {i} " * 20) for i in range(40) for d in (None, 7)]
    one, many = (sorted(map(str, syncmers.edited(frame(spark, hot), blocks=b).collect())) for b in (1, 16))
    assert one == many and len(many) == 80
    assert len({r["block"] for r in syncmers.with_next(frame(spark, hot), 16).collect()}) > 8


def test_blocks_do_not_matter(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = syncmers.edited(d, blocks=1), syncmers.edited(d, blocks=17)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == d.count()


def test_gathered_anchors_against_brute_force(spark):
    r = random.Random(5)
    size = syncmers.CHUNK
    lengths = [1, 7, 8, 39, 40, 41, size - 1, size, size + 1, size + 38, size + 39, size + 40, 2 * size, 2 * size + 39, 3000]
    texts = ["".join(r.choice("ab é𝒳\n") for _ in range(n)) for n in lengths] + ["ab" * size, "z" * (2 * size), "", ("q" * 50 + "r") * 40, "天地" * 400]
    rows = syncmers.edited(frame(spark, enumerate(texts)), blocks=3).collect()
    whole = lambda t: brute(t) or ([(0, xxhash.xxh64_intdigest(t.encode(), 42) >> 16)] if t else [])
    assert len(rows) == len(texts)
    for row in rows:
        t, nxt = texts[row["doc_id"]], texts[(row["doc_id"] + 1) % len(texts)]
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert row["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert unpack(row["fingerprint"]) == whole(t) and unpack(row["edited_fingerprint"]) == whole(e), row["doc_id"]


def test_comparisons_run_as_generated_code(spark):
    """Interpreted, they took most of the time; a method over 8000 bytes of code would be left interpreted by the JVM."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = syncmers.edited(frame(spark, enumerate(samples())), blocks=3)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    lines = plan.toString().splitlines()
    assert any("*(" in x and " Filter " in x and "array_min(slice(h" in x for x in lines)
    # Blocks alone decide where rows are: nothing is dealt again once texts are cut into chunks.
    first, last = (next(k for k, x in enumerate(lines) if name in x) for name in ("ObjectHashAggregate", "Generate posexplode(chunks"))
    assert first < last and not any("Exchange" in x for x in lines[:last])
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    sizes = [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size()) if "array_min(slice(h" in stages.apply(k)._1()]
    assert sizes and max(sizes) < 8000


def test_columns_without_fingerprints(spark):
    sf = "/root/testdata/sf0.001"
    some, full = syncmers.columns(spark, sf), syncmers.query(spark, sf).select("doc_id", "n_chars", "edited_sha256")
    assert some.count() == full.count() and some.exceptAll(full).count() == 0
    assert "posexplode" not in some._jdf.queryExecution().executedPlan().toString()
