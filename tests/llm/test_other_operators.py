import hashlib
import math
import random
import re

import pytest
from oracle import agree

import corpus_pipeline
from keyloom.llm import decontaminate, language, mixing, queries, urls, warc

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert agree(spark, SF, queries.QUERIES[name], queries.SQL[name]) > 0


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/", big, 0), (2, None, big, 0), (3, "u\r\nX: y", None, 0), (4, "v", "", 0), (4, "v", "short", 0), (5, "w", "short", 0), (None, "n", big, 0)]
    path = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, address int"), f"file://{tmp_path}/w")
    got = warc.records(spark, path).collect()
    assert sorted((str(r["id"]), bytes(r["payload"]).decode()) for r in got) == sorted((str(i), h or "") for i, _, h, _ in rows)
    kinds = {(r["id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[2, 1200] == ("response", None) and kinds[1, 1200] == kinds[None, 1200] == ("revisit", 2) and kinds[5, 5] == ("response", None)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    assert all(b"\r\n\r\n" in bytes(r["header"]) for r in got)
    assert warc.records(spark, warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")).count() == 0


def _parse_warc(data):
    """Records (headers, block) of a WARC file, by its grammar alone."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        assert first == "WARC/1.1"
        head = dict(x.split(": ", 1) for x in lines)
        assert len(head) == len(lines)
        n = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
    return out


def test_warc_file_parses(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/", big), (2, None, big), (2, "x\r\nWARC-Type: no", big), (None, "n", big), (None, "n", "q"), (None, "n", "q"), (4, "v", None)]
    path = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w", date="2024-01-02T03:04:05Z")
    parsed = _parse_warc(b"".join(bytes(r["record"]) for r in warc.warc_bytes(warc.records(spark, path)).collect()))
    assert len(parsed) == len(rows) and len({h["WARC-Record-ID"] for h, _ in parsed}) == len(rows)
    by_id = {h["WARC-Record-ID"]: (h, b) for h, b in parsed}
    for h, block in parsed:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= set(h) and h["WARC-Date"] == "2024-01-02T03:04:05Z"
        if h["WARC-Type"] == "revisit":
            target, block = by_id[h["WARC-Refers-To"]]
            assert target["WARC-Type"] == "response" and target["X-Page-ID"] == h["X-Refers-To-Page-ID"] == "2"
        assert h["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest() and int(h["X-Payload-Length"]) == len(block)
    assert sorted(b.decode() for h, b in parsed if h["WARC-Type"] == "response") == sorted(["", "q", "q", big, big])


def test_mixing_targets_and_bounds(spark):
    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 0.03 * v[0]["target"] + 2
    odd = [(1, None, None), (1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (2, "", "t")]
    assert mixing.mix(spark.createDataFrame(odd, "doc_id long, text string, source string")).count() == 5
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mixing_does_not_depend_on_bins(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert mixing.mix(docs, bins=1).exceptAll(mixing.mix(docs, bins=300)).count() == 0


def test_mixing_inclusion_frequencies(spark):
    """Over many seeds each document is drawn as often as its own probability says, and a source always draws as many."""
    r = random.Random(5)
    rows = [(i, "w " * r.choice([3, 5, 6, 7, 9, 10, 11, 13, 14, 17]), "abc"[i % 7 % 3]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    want = {x["doc_id"]: x for x in mixing.inclusion(docs).collect()}
    assert len({x["p"] for x in want.values() if 0 < x["p"]}) > 8
    seeds, drawn, numbers = 16, {}, {}
    for seed in range(seeds):
        for x in mixing.mix(docs, seed=seed, bins=4).collect():
            more = x["copies"] - want[x["doc_id"]]["certain"]
            drawn[x["doc_id"]] = drawn.get(x["doc_id"], 0) + more
            numbers[seed, x["source"]] = numbers.get((seed, x["source"]), 0) + more
    for s in "abc":
        assert len({n for (_, t), n in numbers.items() if t == s}) == 1  # a fixed size, whatever is drawn
    planned = {(x["source"], x["class"]): x["draws"] for x in mixing.draws(mixing.inclusion(docs)).collect()}
    classes = {}
    for d, x in want.items():
        c = classes.setdefault((x["source"], x["class"]), [0, 0.0])
        c[0], c[1] = c[0] + drawn[d], c[1] + x["p"] / mixing.BILLION
    for c, (k, expected) in classes.items():
        assert k == seeds * planned[c] and abs(planned[c] - expected) < 2
    for d, x in want.items():
        n, total = planned[x["source"], x["class"]], classes[x["source"], x["class"]][1]
        p = min(1.0, x["p"] / mixing.BILLION * n / total) if total else 0.0
        assert abs(drawn[d] / seeds - p) < 0.05 + 4.5 * math.sqrt(max(p * (1 - p), 0.01) / seeds), (d, drawn[d], p)


def _edits(item, text):
    """Least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_full_alignment(spark):
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((12, 15, 20, 30))] + [(9, "tiny"), (10, None), (11, "")]
    docs = [(0, None), (1, ""), (2, "TINY "), (3, "tiny x")]
    for k in range(24):
        t = list(r.choice(items[:4])[1])
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(["", "z", "qq"])
        docs.append((10 + k, f"{word()} {word()} {''.join(t)} {word()}".upper() if k % 2 else f"{word()}  {''.join(t)}"))
    got = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontaminate.find(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, edits int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(2, 9): 0}
    for d, t in docs:
        for i, item in items[:4]:
            e = _edits(item, decontaminate.normal(t))
            if t and e <= decontaminate.budget(len(item), decontaminate.EDITS):
                want[d, i] = e
    assert got == want and len(want) > 10
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {x["doc_id"] for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_of_empty_tables_and_long_items(spark):
    docs = spark.createDataFrame([(1, "some text that is long enough")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some text that is long enough")], "item_id long, text string")
    assert decontaminate.find(docs, items.limit(0)).count() == decontaminate.find(docs.limit(0), items).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == 1 and decontaminate.clean(docs.limit(0), items).count() == 0
    r = random.Random(2)
    item = " ".join(f"w{r.randrange(10**9)}" for _ in range(110_000))
    index = decontaminate.Index([(5, item)])
    assert len(item) > 1 << 20 and index.find(f"x {item} y") == [(5, 0, len(item) + 2)]
    cut = item[: 700_000] + "#" + item[700_001:]
    assert [x[0] for x in decontaminate.Index([(5, item)], edits=0.0001).find("z " + cut)] == [5]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.predictions(docs, language.train(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out AND lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows) > 200
    got = {t: language.predictions(spark.createDataFrame([(1, t, "en")], "doc_id long, text string, lang string"), language.train(docs)).first()["lang_pred"] for t in ("½", "①²", "_", "Ⅷ", "a", "ª")}
    assert {t for t, p in got.items() if p == "und"} == {"½", "①²", "_", "Ⅷ"}
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (None, "hello", None), (4, "x " * 50000, "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predictions(odd, None).collect()}
    assert got[1] == got[2] == ("und", 0.0) and len(got) == 4


def test_language_sample_is_bounded_and_rows_repeat(spark):
    words = {"en": "the cat and that hat", "de": "der hund und das haus"}
    rows = [(None, f"{words[k]} {i}", k, 1.0) for i in range(400) for k in words] + [(7, "the same text", "en", 1.0)] * 300 + [(8, None, "en", 0.0), (9, "x", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    seen = []
    fit = language.Model
    try:
        language.Model = lambda x, langs: seen.append((x, langs)) or fit(x, langs)
        model = language.train(docs, per_language=50)
    finally:
        language.Model = fit
    assert len(seen) == 1 and all(0 < seen[0][1].count(k) <= 50 for k in words)
    got = [tuple(r) for r in language.identify(docs, model).select("doc_id", "text", "lang_pred", "score").collect()]
    assert len(got) == len(rows) and len({g for g in got if g[0] == 7}) == 1
    empty = docs.limit(0)
    assert language.train(empty) is None and language.identify(empty, None).count() == 0


def _rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for text, says in urls.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = (text, says)
    return host, path, best


def test_url_rules(spark):
    odd = ["http://A.Example.NET/en/x?q#f", "http://example.net/enx", "ftp://net/", "http://net?x", "x.org/fr/", None, "", "http://b.org/fr/a#b", "http://example.com/de/", "http://notexample.com/de/", "a://b://net/"]
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [(-1 - i, u) for i, u in enumerate(odd)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame([(*p, "") for p in pages], "page_id long, url string, host string")).collect()}
    for d, url in pages:
        host, path, best = _rule(url)
        assert (got[d]["host"], got[d]["path"], got[d]["rule"]) == (host, path, best and best[0]), url
        assert got[d]["verdict"] in ("allow", "block") and (best is None or got[d]["verdict"] == best[1])


def _scores(texts):
    """(text, verdict) by text: ratio per character, from exact counts of every (order, context, character)."""
    seen = {"allow": {}, "block": {}}
    runs = lambda t: [(t[max(0, i - urls.ORDER) : i].rjust(urls.ORDER, "\x02"), t[i]) for i in range(len(t))]
    for t, verdict in texts:
        for context, c in runs(t) if verdict else ():
            for k in range(urls.ORDER + 1):
                ctx, n = context[urls.ORDER - k :], seen[verdict]
                n[k, ctx, c] = n.get((k, ctx, c), 0) + 1
                n[k, ctx] = n.get((k, ctx), 0) + 1

    def log_p(n, context, c):
        p = 1 / 256
        for k in range(urls.ORDER + 1):
            ctx = context[urls.ORDER - k :]
            p = (n.get((k, ctx, c), 0) + urls.A * p) / (n.get((k, ctx), 0) + urls.A)
        return math.log(p)

    return {t: sum(log_p(seen["allow"], *x) - log_p(seen["block"], *x) for x in runs(t)) / len(t) for t, _ in texts if t}


def test_url_scores_from_exact_counts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(8))
    hosts = ["a.example.net/en", "example.com/de", "b.org/fr", "b.net", "other.info"]
    pages = [(i, f"http://{r.choice(hosts)}/{word()}/{word()}/{word()}") for i in range(1500)]
    pages += pages[:40]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()
    url = dict(pages)
    want = _scores([(url[x["page_id"]], x["rule"] and x["verdict"]) for x in got])
    open_ = [x for x in got if x["rule"] is None]
    assert len(got) == len(pages) and len(open_) > 100
    assert all(abs(x["score"] - want[url[x["page_id"]]]) < 1e-9 for x in open_)


def test_url_threshold_is_held_out_and_odd_tables(spark):
    r = random.Random(6)
    word = lambda a: "".join(r.choice(a) for _ in range(9))
    good, bad = "abcdefgh", "qrstuvwxyz0123456789"
    pages = [(i, f"http://a.example.net/en/{word(good)}/{word(good)}", "x") for i in range(600)] + [(i, f"http://b.net/{word(bad)}/{word(bad)}", "x") for i in range(600)]
    pages += [(None, f"http://c.info/{word(good)}/{word(good)}", "g") for _ in range(150)] + [(None, f"http://c.info/{word(bad)}/{word(bad)}", "b") for _ in range(150)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, score string")).collect()
    url = {u: k for _, u, k in pages}
    truth = {f"{u[7:].split('/')[0]}{u[7:][u[7:].index('/'):]}": k for u, k in url.items()}
    open_ = [(x["verdict"], truth[x["host"] + x["path"]]) for x in got if x["rule"] is None]
    assert len(got) == len(pages) and len(open_) == 300
    assert sum((v == "allow") == (k == "g") for v, k in open_) > 0.95 * len(open_)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_scores_cover_the_whole_url(spark):
    pages = [(i, f"https://a.example.net/en/{i}?ref=good") for i in range(30)] + [(100 + i, f"https://a.net/{i}?ad=spam#x") for i in range(30)]
    pages += [(200, "https://other.info/p?ref=good"), (201, "https://other.info/p?ad=spam#x"), (202, "example?ref=good"), (203, None), (204, "")]
    got = {x["page_id"]: x for x in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert len(got) == len(pages) and got[200]["score"] > got[201]["score"]
    assert [got[i]["verdict"] for i in (200, 201, 202, 203, 204)] == ["allow", "block", "allow", "block", "block"]
    assert got[202]["score"] is not None and (got[202]["host"], got[202]["path"]) == ("", "")
    assert got[203]["score"] is got[204]["score"] is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, kept, SF), name)
        assert out.columns == docs.columns
        kept = out
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids <= set(before) and len(ids) > 0.6 * len(before)
    assert not kept.filter(kept["text"].rlike(r"[a-z]+\.\d\d@mail\d\.example\.com")).count()
    mixed = corpus_pipeline.mixture(spark, kept, SF)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    item = "the benchmark question that nobody may train on at all"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a = " ".join(f"alpha{i} beta" for i in range(30))
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (2, a + " more", None, None), (None, a, "en", "s"), (None, "another text of its own, quite short", "en", "s")]
    rows += [(3, None, "en", "s"), (3, "", None, "s"), (4, f"some words and {item} and more", "de", "t"), (5, "write to jo@example.com now please", "en", "t"), (5, "the same number, another text", "en", "t")]
    rows += [(6, "!!! 123", "en", "t")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _first string")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda d: sorted((str(r["doc_id"]), r["text"]) for r in d.collect())
    docs = stages["language"](spark, docs, str(tmp_path))
    assert texts(docs) == sorted((str(r[0]), r[1]) for r in rows if r[1] not in (None, "", "!!! 123"))
    docs = stages["near_duplicates"](spark, docs, str(tmp_path))
    kept = [(1, a), (None, rows[4][1]), (4, rows[7][1]), (5, rows[8][1]), (5, rows[9][1])]
    assert texts(docs) == sorted((str(d), t) for d, t in kept)
    docs = stages["benchmark"](spark, docs, str(tmp_path))
    docs = stages["personal_data"](spark, docs, str(tmp_path))
    assert texts(docs) == sorted((str(d), t.replace("jo@example.com", "[EMAIL]")) for d, t in kept if item not in t)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_first"]
    assert stages["mixture"](spark, docs, str(tmp_path)).count() <= 4
    empty = docs.limit(0)
    for stage in stages.values():
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_drops_near_copies_from_80_percent(spark):
    words = [f"w{i}" for i in range(204)]
    changed = lambda k: " ".join("x" if i in range(5, 10 * k, 10) else w for i, w in enumerate(words))
    # 200 shingles, of which each changed word takes 5: similarity 180/220 = 0.82 with 4 words, 165/235 = 0.70 with 7.
    rows = [(1, changed(0)), (2, changed(4)), (3, " ".join(f"v{i}" for i in range(50)))]
    far = [(4, " ".join("y" if i in range(5, 70, 10) else w for i, w in enumerate(words)))]
    kept = lambda r: sorted(x["doc_id"] for x in corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(r, "doc_id long, text string"), SF).collect())
    assert kept(rows) == [1, 3] and kept([rows[0], *far]) == [1, 4]
