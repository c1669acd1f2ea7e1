"""Language identification: family first, then one-versus-one linear SVMs inside it.

A text becomes hashed counts of its letters' 1- to 3-grams (square roots,
length 1).  One linear SVM separates each pair of families and each pair of
languages of a family; the most votes win, ties go to the larger sum of
margins.  The score is the product of the logistic of the winner's weakest
margins in both steps, between 0 and 1.

Training texts are a sample: at most ``per_language`` distinct labelled texts of
each of the ``LANGUAGES`` most frequent languages, those with the smallest hash of
id and text, so the fit has a bound whatever the input is, null or repeated ids
included.  Prediction covers whole texts of all rows.

Text null or without a letter: ``und``, score 0.  Null lang: not learned from.
Null id: hashed as an empty string, never held out.  No usable label at all:
every text is ``und``.  Repeated rows get equal results.  Empty table: empty
result.  Extra columns are ignored (``identify`` keeps them).

A letter is a character of the Unicode categories L*, as in ``\\p{L}``.
"""

from __future__ import annotations

import itertools
import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIM = 4096
PER_LANGUAGE, LANGUAGES = 500, 200
_FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "indic": "hi bn ur pa mr gu ne si",
    "turkic": "tr az kk uz ky tt",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
FAMILY = {code: family for family, codes in _FAMILIES.items() for code in codes.split()}
_NOT_LETTERS = re.compile(r"\P{L}+")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def family(lang: str) -> str:
    """A language that the table doesn't know is a family of its own."""
    return FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of hashed letter n-grams of the whole text; None without a letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()) if text else ""
    if not words.strip():
        return None
    c = np.frombuffer(f" {words.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(DIM)
    h = np.zeros(len(c), np.uint32)
    for n in range(3):
        if len(c) <= n:
            break
        h = h[: len(c) - n] * np.uint32(31) + c[n:] * _MULTIPLIERS[n]
        x = h ^ (h >> np.uint32(15))
        out += np.bincount((x * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=DIM)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient; y is +1 or -1."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * c / len(y)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w = z = np.zeros(x1.shape[1])
    step, t = 1 / (1 + 2 * (weight[:, None] * x1**2).sum()), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ z))
        new = z - step * (z - 2 * x1.T @ (weight * y * slack))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w[:-1].astype(np.float32), float(w[-1])


class Tournament:
    """One-versus-one linear SVMs between groups of labels."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.labels, label = sorted(set(labels)), np.array(labels)
        self.pairs = list(itertools.combinations(range(len(self.labels)), 2))
        fits = []
        for a, b in self.pairs:
            use = np.isin(label, [self.labels[a], self.labels[b]])
            fits.append(fit_svm(x[use], np.where(label[use] == self.labels[a], 1.0, -1.0)))
        self.w = np.array([w for w, _ in fits], np.float32).reshape(len(fits), x.shape[1])
        self.b = np.array([b for _, b in fits], np.float32)

    def best(self, v: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.labels[0], 1.0
        margin = self.w @ v + self.b
        n = len(self.labels)
        votes, total, worst = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        for (a, b), m in zip(self.pairs, margin, strict=True):
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            worst[a], worst[b] = min(worst[a], m), min(worst[b], -m)
        k = max(range(n), key=lambda i: (votes[i], total[i]))
        return self.labels[k], float(1 / (1 + np.exp(-3 * worst[k])))


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        fams = [family(k) for k in langs]
        self.top = Tournament(x, fams)
        self.inside = {f: Tournament(x[[g == f for g in fams]], [k for k, g in zip(langs, fams, strict=True) if g == f]) for f in self.top.labels}

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text)
        if v is None:
            return "und", 0.0
        f, p = self.top.best(v)
        lang, q = self.inside[f].best(v)
        return lang, p * q


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on a hash sample of the labelled rows that aren't held out."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"), F.lit(8))
    known = known.select("lang", "text", order.alias("order"))
    top = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("order").alias("d")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not top:
        return None
    # A share of the hashes that leaves about three times as many texts, whatever repeats; of those the smallest.
    share = F.lit(0.0)
    for r in top:
        share = F.when(F.col("lang") == r["lang"], min(1.0, 3 * per_language / max(1, r["d"]))).otherwise(share)
    some = known.filter(F.pmod("order", F.lit(1 << 30)) / float(1 << 30) < share).groupBy("lang", "order").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    sample = some.withColumn("_r", rank).filter(F.col("_r") <= per_language).select("lang", "text")

    def vectors(batches):
        for pdf in batches:
            v = [features(t) for t in pdf["text"]]
            keep = [x is not None for x in v]
            yield pd.DataFrame({"lang": pdf["lang"][keep], "x": [x.astype(np.float16).tobytes() for x in v if x is not None]})

    rows = sample.mapInPandas(vectors, "lang string, x binary").collect()  # at most per_language * LANGUAGES rows of 8 KB
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Model(np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score (columns of these names are replaced)."""
    keep = docs.drop("lang_pred", "score")
    fields = keep.schema.fields
    schema = type(keep.schema)([*fields]).add("lang_pred", "string").add("score", "double")

    def run(batches):
        for pdf in batches:
            got = [model.predict(t) if model else ("und", 0.0) for t in pdf["text"]]
            pdf["lang_pred"], pdf["score"] = [g[0] for g in got], np.array([g[1] for g in got], float)
            yield pdf

    return keep.mapInPandas(run, schema)


def predictions(docs: DataFrame, model: Model | None) -> DataFrame:
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predictions(docs, train(docs))

