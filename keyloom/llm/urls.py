"""Judge URLs by rules and, where none fits, by a character language model ratio.

DataFrame functions only.  Two smoothed variable-order Markov models, of the
URLs that rules accept and of those they reject, give a log-likelihood ratio
per character; a URL passes when it lies above a threshold calibrated on
held-out labelled URLs: of the distinct ones, every fourth by hash is scored by
models that were trained on the others (the threshold is where two normal
distributions with the measured means and deviations err equally).  URLs without
a rule are scored by models of all labelled ones.

A model holds the counts of all character strings of up to ``ORDER`` + 1 and of
their contexts, for all labelled rows.  They are exact and a table, so a model
grows with what it is trained on; the grams of each distinct text are joined to it.
Order k is smoothed with order k - 1: p_k = (n(ctx, c) + A p_{k-1}) / (n(ctx) + A).

Models train on and score the whole URL as it stands, scheme, query and fragment
too; host and path serve the rules only.  URL without ``://``: host and path
empty, no rule, judged by its score.  URL null or empty: host and path empty, no
rule, verdict block (there is nothing to judge).  If rules accept or reject no
URL at all, or none of the held-out ones, the ratio has no threshold and the
verdict is allow.  Repeated rows are judged alike, null ids too.  Empty table:
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.common import temporary, written

ORDER, A = 4, 1.0
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def parse(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(u, pattern, 2)


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule whose host is the URL's or a parent of it and whose path starts the URL's."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        which, verdict = F.when(fits, text).otherwise(which), F.when(fits, says).otherwise(verdict)
    return which, verdict


def _grams(text: Column) -> Column:
    """Every character with the ORDER before it; O(length)."""
    return F.regexp_extract_all(F.concat(F.lit("\x02" * ORDER), text), F.lit(rf"(?s)(?=(.{{{ORDER + 1}}}))."), F.lit(1))


def model(grams: DataFrame) -> DataFrame:
    """(gram, a, r) -> (gram, llr): counts in accepted and rejected texts to the log-likelihood ratio of the last character."""
    out = None
    for k in range(ORDER + 1):
        n = grams.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("w")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = Window.partitionBy(F.substring("w", 1, k))
        n = n.withColumn("na", F.sum("a").over(context)).withColumn("nr", F.sum("r").over(context))
        if out is None:
            n = n.withColumn("pa", F.lit(1.0 / 256)).withColumn("pr", F.lit(1.0 / 256))
        else:
            n = n.withColumn("shorter", F.substring("w", 2, k)).join(out.withColumnRenamed("w", "shorter"), "shorter")
        p = lambda x: (F.col(x) + A * F.col(f"p{x}")) / (F.col(f"n{x}") + A)
        out = written(n.select("w", p("a").alias("pa"), p("r").alias("pr")), "order")
    return out.select(F.col("w").alias("gram"), (F.log("pa") - F.log("pr")).alias("llr"))


def ratios(rows: DataFrame) -> DataFrame:
    """(text, verdict) -> (text, score, held): log-likelihood ratio per character of each distinct text that isn't empty.

    ``held``: the same by models without the held-out texts, null for the others.
    """
    held = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(4)) == 0
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("r"))
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()).withColumn("held", held & (F.col("a") + F.col("r") > 0)), "texts")
    # Written, so that the join has exchanges of its own and a gram that many texts have can be split.
    each = written(texts.select("id", "a", "r", "held", F.explode(_grams(F.col("text"))).alias("gram")), "grams")

    def scored(seen: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
        known = written(seen.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "counts")
        return wanted.select("id", "gram").join(model(known), "gram").groupBy("id").agg(F.avg("llr").alias(name))

    # What the held-out texts alone have counts as seen in neither kind.
    apart = each.withColumns({c: F.when(F.col("held"), 0).otherwise(F.col(c)) for c in ("a", "r")})
    out = texts.select("id", "text").join(scored(each, each, "score"), "id").join(scored(apart, each.filter("held"), "held"), "id", "left")
    return out.select("text", "score", "held")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score); score is null where a rule decides."""
    host, path = parse(F.col(url_col))
    d = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.coalesce(F.col(url_col), F.lit("")).alias("text"))
    which, verdict = rule_for(F.col("host"), F.col("path"), rules)
    d = d.withColumn("rule", which).withColumn("verdict", verdict)
    d = written(d, "urls")
    with temporary() as keep:
        scores = keep(written(ratios(d), "ratios"))
    d = d.join(scores, "text", "left")
    scored = d.filter(F.col("held").isNotNull()).select("text", "verdict", F.col("held").alias("score")).distinct()
    ok = F.col("verdict") == "allow"
    side = lambda f, c: f(F.when(c, F.col("score")))
    ma, mr, sa, sr = side(F.avg, ok), side(F.avg, ~ok), side(F.stddev_pop, ok), side(F.stddev_pop, ~ok)
    limit = scored.agg(F.coalesce((ma * sr + mr * sa) / F.nullif(sa + sr, F.lit(0.0)), (ma + mr) / 2).alias("limit")).first()["limit"]
    score = F.when(F.col("rule").isNull(), F.col("score"))
    d = d.withColumn("score", score).withColumn("limit", F.lit(limit).cast("double"))
    says = F.when(F.length("text") == 0, "block").when(F.col("limit").isNull() | (F.col("score") >= F.col("limit")), "allow").otherwise("block")
    return d.select(id_col, "host", "path", "rule", F.coalesce("verdict", says).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The columns that SQL can express.
SQL = r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
 p AS (SELECT page_id, translate(x.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, x.path AS path FROM u),
 f AS (SELECT page_id, host, path, list_filter([{'rule': 'net/', 'h': 'net', 'p': '/'}, {'rule': 'example.net/en/', 'h': 'example.net', 'p': '/en/'}, {'rule': 'example.com/de/', 'h': 'example.com', 'p': '/de/'}, {'rule': 'org/fr/', 'h': 'org', 'p': '/fr/'}],
  lambda r: (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)) AS fits FROM p)
SELECT page_id, host, path, list_reduce(list_transform(fits, lambda r: r.rule), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS rule FROM f WHERE len(fits) > 0
UNION ALL SELECT page_id, host, path, NULL FROM f WHERE len(fits) = 0
"""
