"""Personal data by weak supervision, with DataFrame functions only.

Four base patterns (email, ip, card, phone) are findings by definition.  Looser
candidates (credentials, names after titles, local phone numbers, spelled-out
addresses, national and bank numbers) are judged: five labelers (format,
gazetteer, context for, context against, shape) vote for, against or abstain;
expectation-maximisation over the counts of all vote patterns estimates how
reliable each labeler is and how likely each pattern is personal data; with
those likelihoods as soft labels a span classifier (naive Bayes over hashed
features of the span and its surroundings) is trained on all candidates and
decides.  Base spans take part in the training and are never dropped.

What reaches the driver are the vote patterns (at most kinds * 3**5 rows) and
one row for each of ``SLOTS`` feature counters, whatever the table holds.

Positions are code points, ends exclusive.  Patterns are searched leftmost and
without overlap per kind; an added span never overlaps a base span.  Text null
or empty: no spans.  Repeated rows get equal results.  Empty table: empty
result.  Extra columns are ignored (``mask`` keeps them).
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import let, text_of, written

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "person", "phone_local", "email_spelled", "ssn", "iban")
SLOTS, AROUND, ROUNDS = 4096, 24, 60
MILLION = 1_000_000

# Possessive runs behind a look at the character before match what the plain patterns match, in linear time.
_L, _D = r"A-Za-z0-9._%+-", r"A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![{_L}]))[{_L}]++@[{_D}]++\.(?=[{_D}])(?:[{_D}.](?<!\.(?![{_D}])))++"
IP = r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
CARD_START = r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
EXTRA = (
    rf"{PHONE}|(?<![{_L}])[{_L}]++@[A-Za-z0-9.-]++"
    rf"|(?<![{_L}])[{_L}]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9.-]++ ?[\[(] ?dot ?[\])] ?[A-Za-z]{{2,24}}"
    r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}"
    r"|(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.? \p{Lu}[\p{L}'-]++(?: \p{Lu}[\p{L}'-]++)?"
)
#: What each match of EXTRA holds: one of these, or a digit in such surroundings (of a run of 16, eight stand on one side of any digit).
EXTRA_PARTS = ("+", "@", "Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sr")
EXTRA_DIGIT = r"[0-9](?:[0-9]{2}[ .)-]|(?<=[A-Z]{2}[0-9])[0-9]|[A-Za-z0-9_+/-]{8}|(?<=[A-Za-z0-9_+/-]{9}))"
EXTRA_AT = r"[\[(] ?at ?[\])]"
#: The gazetteer labeler's lists.
DOMAINS = "com org net edu gov info io de fr es it uk eu ch at be nl"
GIVEN = "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph anna maria jose juan carlos luis pedro ana laura hans peter klaus karl jean pierre marie claire sophie louis paul luca"
ISSUERS = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|sk_live|sk-|xox[bap]-|eyJ)"
FOR = r"(?i)(?:pass(?:word|wd|wort)?|secret|token|api[ _-]?key|key|login|user|mail|contact|kontakt|call|tel|phone|fax|mobil\w*|ssn|iban|konto|account|card|name|adresse?|ip)\W*$"
AGAINST = r"(?i)(?:version|isbn|issn|doi|order|invoice|page|fig(?:ure)?|table|section|no|nr|sha|commit|hash|build|md5|uuid|img|src|href|/)\W*$"


_SPANS = "array<struct<start:int,end:int,txt:string>>"


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, txt>> of all matches, from the matches and the pieces between them."""

    def fold(m: Column, pieces: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(m, i))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.get(m, i).alias("txt")))).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), zero, step)["out"]

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, F.array().cast(_SPANS)).otherwise(let(F.split(text, pattern, -1), lambda p: fold(m, p))))


def _digits(txt: Column) -> Column:
    return F.regexp_replace(txt, "[^0-9]", "")


def _luhn(txt: Column) -> Column:
    d = F.transform(F.regexp_extract_all(F.reverse(_digits(txt)), F.lit("[0-9]"), F.lit(0)), lambda c, i: (F.ascii(c) - 48) * (1 + i % 2))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


_BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
_VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda x: F.length(_digits(x)).between(10, 15),
}


def _needs(text: Column) -> dict[str, Column]:
    """What every match of a kind holds; a text without it isn't searched."""
    return {"email": text.contains("@"), "ip": text.contains("."), "card": text.rlike(CARD_START), "phone": text.contains("+")}


def base_spans(text: Column) -> Column:
    """array<struct<start, ord, end, kind, txt>> by start, then kind as listed."""
    needs = _needs(text)

    def part(ord_: int, kind: str, pattern: str) -> Column:
        found = F.when(needs[kind], _found(text, pattern)).otherwise(F.array().cast(_SPANS))
        good = F.filter(found, lambda s: _VALID[kind](s["txt"]))
        return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(ord_).alias("ord"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["txt"].alias("txt")))

    return F.sort_array(F.concat(*[part(k, kind, pattern) for k, (kind, pattern) in enumerate(_BASE.items())]))


def base_counts(text: Column) -> list[Column]:
    """How many base spans of each kind a text has: n_<kind>."""
    needs = _needs(text)
    good = lambda kind: F.filter(F.regexp_extract_all(text, F.lit(_BASE[kind]), F.lit(0)), _VALID[kind])
    return [F.when(needs[kind], F.size(good(kind))).otherwise(0).cast("long").alias(f"n_{kind}") for kind in KINDS]


def _kind_of(txt: Column) -> Column:
    out = F.when(txt.startswith("+") | txt.contains("@"), F.lit(None).cast("string"))  # base patterns, consumed here
    out = out.when(txt.rlike(r"[\[(] ?at ?[\])]"), "email_spelled").when(txt.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(txt.rlike(r"^\(?[0-9]{3}\)?[ .-]"), "phone_local")
    out = out.when(txt.rlike(r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$") & ~txt.startswith("AK"), "iban").when(txt.rlike(r"^\p{L}+\.? \p{Lu}"), "person")
    return out.otherwise("secret")


def _may_hold_more(text: Column) -> Column:
    """False only where EXTRA has no match; far quicker than searching the text."""
    parts = [text.contains(x) for x in EXTRA_PARTS]
    return reduce(lambda a, b: a | b, [*parts, text.rlike(EXTRA_DIGIT), text.rlike(EXTRA_AT)])


def added_candidates(text: Column, base: Column) -> Column:
    """Candidates of the looser kinds that overlap no base span."""
    found = F.when(_may_hold_more(text), _found(text, EXTRA)).otherwise(F.array().cast(_SPANS))
    each = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("ord"), s["end"].alias("end"), _kind_of(s["txt"]).alias("kind"), s["txt"].alias("txt")))
    return F.filter(each, lambda s: s["kind"].isNotNull() & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _context(text: Column, spans: Column) -> Column:
    """Adds before, after (up to AROUND code points)."""
    return F.transform(
        spans,
        lambda s: F.struct(
            *(s[c].alias(c) for c in ("start", "ord", "end", "kind", "txt")),
            F.substring(text, F.greatest(s["start"] - AROUND, F.lit(0)) + 1, F.least(s["start"], F.lit(AROUND))).alias("before"),
            F.substring(text, s["end"] + 1, F.lit(AROUND)).alias("after"),
        ),
    )


def _in(words: str, value: Column) -> Column:
    return F.coalesce(F.lower(value).isin(words.split()), F.lit(False))


def _votes(s: Column) -> Column:
    """Five characters, one for each labeler: + for, - against, 0 abstains."""
    txt, kind = s["txt"], s["kind"]
    n, n_digits = F.length(txt), F.length(_digits(txt))
    is_in = lambda *k: kind.isin(*k)
    # Digests name files and commits as often as they are keys: their look says nothing.
    digest = txt.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$")
    sign = lambda plus, minus=F.lit(False): F.when(plus, "+").when(minus, "-").otherwise("0")
    separators = F.length(F.regexp_replace(txt, "[A-Za-z0-9=]", ""))
    path = txt.startswith("/") | (separators > 2)
    regex = sign(
        is_in(*KINDS, "email_spelled", "iban") | is_in("ssn") & ~txt.rlike("^(?:000|666|9)") | is_in("phone_local") & txt.rlike(r"^\(?[2-9]") | is_in("secret") & ~digest & ~path & txt.rlike(r"^(?:[0-9a-f]{32,64}|[A-Z0-9]{20}|[A-Za-z0-9_+/-]{24,64}={0,2})$"),
        is_in("ssn", "phone_local"),
    )
    last = F.element_at(F.split(txt, r"[.\s]+"), -1)
    gazetteer = sign(is_in("email") & _in(DOMAINS, last) | is_in("email_spelled") & _in(DOMAINS, last) | is_in("person") & (_in(GIVEN, F.get(F.split(txt, " "), F.lit(1))) | txt.rlike(r"^(?:Mrs?|Dr|Prof)")) | is_in("secret") & txt.rlike(ISSUERS))
    context_for = sign(s["before"].rlike(FOR))
    context_against = sign(F.lit(False), s["before"].rlike(AGAINST))
    mixed = n_digits.between(F.floor(n * 0.15), F.floor(n * 0.9))
    shape = sign(is_in("secret") & mixed & ~digest & ~path | is_in(*KINDS, "phone_local", "ssn", "iban"), is_in("secret") & (~mixed | path))
    return F.concat(regex, gazetteer, context_for, context_against, shape)


def _features(s: Column) -> Column:
    """Counters of the final classifier that this span touches."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["txt"], r"\p{Lu}+", "A"), r"[\p{Ll}\p{Lo}]+", "a"), "[0-9]+", "9")
    kind = s["kind"]
    word = F.regexp_extract(F.lower(s["before"]), r"([\p{L}\p{N}]+)\W*$", 1)
    glue = F.regexp_extract(s["before"], r"(\W*)$", 1)
    raw = [
        F.concat(F.lit("k:"), kind),
        F.concat(F.lit("n:"), kind, F.least(F.floor(F.length(s["txt"]) / 4), F.lit(16)).cast("string")),
        F.concat(F.lit("s:"), kind, F.substring(shape, 1, 12)),
        F.concat(F.lit("w:"), kind, word),
        F.concat(F.lit("g:"), kind, F.right(glue, F.lit(2))),
        F.concat(F.lit("a:"), kind, F.substring(s["after"], 1, 1)),
        F.concat(F.lit("p:"), kind, F.substring(s["txt"], 1, 4)),
        F.concat(F.lit("d:"), kind, F.floor(F.length(_digits(s["txt"])) * 8 / F.length(s["txt"])).cast("string")),
    ]
    return F.array(*[F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int") for x in raw])


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, base (spans) and cand (base and looser spans with votes and feature counters)."""
    text = F.col("_t")
    d = docs.select(*keep, text_of("text").alias("_t"))
    d = d.withColumn("base", base_spans(text))
    d = d.withColumn("loose", added_candidates(text, F.col("base")))
    d = d.withColumn("cand", _context(text, F.concat("base", "loose")))
    slim = F.transform("cand", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["ord"].alias("ord"), _votes(s).alias("votes"), _features(s).alias("slots")))
    return d.select(*keep, F.transform("base", lambda s: s.dropFields("txt")).alias("base"), slim.alias("cand"))


def em(counts: dict[tuple[str, str], int], rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """(kind, votes) -> likelihood of personal data.

    Each labeler has one reliability (the share of its votes that are right),
    each kind one prior; abstaining says nothing.  Reliabilities stay above
    chance (0.6 to 0.99), so the two classes can't swap their names.
    """
    p = {k: 1 / (1 + math.exp(-1.5 * (k[1].count("+") - k[1].count("-")))) for k in counts}
    for _ in range(rounds):
        yes: dict[str, float] = {}
        n_of: dict[str, float] = {}
        right, cast = [8.0] * 5, [10.0] * 5
        for (kind, votes), n in counts.items():
            q = p[kind, votes]
            yes[kind] = yes.get(kind, 1.0) + n * q
            n_of[kind] = n_of.get(kind, 2.0) + n
            for i, v in enumerate(votes):
                if v != "0":
                    right[i] += n * (q if v == "+" else 1 - q)
                    cast[i] += n
        weight = [math.log(r / (1 - r)) for r in (min(0.99, max(0.6, a / b)) for a, b in zip(right, cast, strict=True))]
        for kind, votes in p:
            odds = math.log(yes[kind] / (n_of[kind] - yes[kind])) + sum(w * ((v == "+") - (v == "-")) for w, v in zip(weight, votes, strict=True))
            p[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return p


def fit(cand: DataFrame) -> list[float]:
    """The classifier: a weight for each counter, the last one the bias."""
    each = cand.select(F.explode("cand").alias("s"))
    counts = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [0.0] * (SLOTS + 1)
    soft = {f"{k}|{v}": round(p * MILLION) for (k, v), p in em(counts).items()}
    table = F.from_json(F.lit(json.dumps(soft)), "map<string,bigint>")
    p = F.element_at(table, F.concat_ws("|", "s.kind", "s.votes"))
    sums = each.select(p.alias("p"), F.explode("s.slots").alias("slot")).groupBy("slot").agg(F.sum("p").alias("yes"), F.sum(MILLION - F.col("p")).alias("no")).collect()
    yes, no = sum(r["yes"] for r in sums) + MILLION, sum(r["no"] for r in sums) + MILLION
    add = 4.0 * MILLION  # smoothing towards the share of all, so that a rare feature says little
    weights = [0.0] * SLOTS
    for r in sums:
        y, n = r["yes"] + add * yes / (yes + no), r["no"] + add * no / (yes + no)
        weights[r["slot"]] = round(math.log(y / n) - math.log(yes / no), 6)
    return [*weights, round(math.log(yes / no), 6)]


def decided(cand: Column, base: Column, weights: list[float]) -> Column:
    """All spans by start, then kind: the base ones and those that the classifier accepts."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    yes = lambda s: F.aggregate(s["slots"], F.lit(weights[-1]), lambda a, i: a + F.get(table, i)) > 0
    more = F.transform(F.filter(cand, lambda s: (s["ord"] == len(KINDS)) & yes(s)), lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.sort_array(F.concat(base, more))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of spans for every document."""
    c = written(candidates(docs, "doc_id"), "spans")
    return c.select("doc_id", "base", decided(F.col("cand"), F.col("base"), fit(c)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).otherwise("")
        put = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(put)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def mask(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with the spans in ``text`` masked; n_chars, where there is one, follows."""
    names = docs.columns
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("_row")
    c = written(candidates(docs.select(row, "text"), "_row"), "pii")
    spans = c.select("_row", decided(F.col("cand"), F.col("base"), fit(c)).alias("_spans"))
    cols = {n: F.col(f"_row.c{i}") for i, n in enumerate(names)}
    new = F.when(cols["text"].isNotNull(), masked(cols["text"], F.col("_spans")))
    spans = spans.withColumn("_new", new)
    cols["text"] = F.col("_new")
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.size("_spans") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return spans.select(*[cols[n].alias(n) for n in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *map(count, KINDS), F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that SQL can express: they need neither positions nor the added kinds, so nothing else is searched."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *base_counts(text_of("text")))


#: The columns that SQL can express.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
 len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
 len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS BIGINT), 0) > 255)) = 0)) AS n_ip,
 len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))),
  lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(x, ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0)) AS n_card,
 len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) AS n_phone
FROM d
"""
