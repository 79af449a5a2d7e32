"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader and elastic-net penalties, calibrated by a temperature.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, ship, unused

#: Code points of a text that are hashed at a time.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Settings:
    """sample: labelled texts a language is fitted on at most; labels: languages that are learned at most, the most frequent ones (the bounds of the fit's sample)."""

    sample: int = 600
    labels: int = 200
    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2e-3
    l2: float = 1e-4


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages, IDF included
    bias: np.ndarray
    temperature: float


def _grams(text: str, s: Settings):
    """Bucket numbers of the character n-grams of a text, block by block; each n-gram belongs to the block in which it ends.

    The text is lower-cased, and everything but letters counts as a space; runs of spaces stay runs.
    """
    step, text = max(s.orders) - 1, text.lower()
    for at in range(0, len(text), BLOCK):
        lead = min(at, step)
        x = np.frombuffer(text[at - lead:at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        x = np.where(_letter(x), x, np.uint64(32))
        for n in s.orders:
            y = x[max(0, lead - (n - 1)):]
            h = np.full(max(0, len(y) - n + 1), n, np.uint64)
            for k in range(n):
                h = (h ^ y[k:len(y) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h % np.uint64(s.buckets)).astype(np.int64)


_table: list[np.ndarray] = []


def _letter(x: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _table[0][x]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _counts(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(s.buckets, np.int64)
    for g in _grams(text, s):
        total += np.bincount(g, minlength=s.buckets)
    at = np.flatnonzero(total)
    return at, total[at]


def document_frequencies(docs: DataFrame, s: Settings) -> tuple[int, np.ndarray]:
    """Number of rows, and for each bucket the rows whose text has an n-gram in it. Every row counts.

    A task sums its rows before the shuffle; the result has as many numbers as there are buckets.
    """
    def run(batches):
        total, n, seen = np.zeros(s.buckets, np.int64), 0, np.zeros(s.buckets, bool)
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                for g in _grams(text, s):
                    seen[g] = True
                total += seen
                seen[:] = False
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["g", "n"])

    rows = docs.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(s.buckets)
    inside = rows[rows.g >= 0]
    df[inside.g] = inside.n
    return int(rows[rows.g < 0].n.sum()), df


def sample(docs: DataFrame, s: Settings) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of about s.sample different texts of each language, chosen by a hash of the text, in a fixed order.

    Shares follow from the number of different texts, so a language of many copies isn't left out. Rows come as packed
    numbers, a partition at a time: the driver holds little besides the sample.
    """
    n = F.approx_count_distinct("t", 0.02)
    shares = (docs.groupBy("lang").agg(n.alias("n")).orderBy(F.col("n").desc(), "lang").limit(s.labels)
              .select(F.col("lang").alias("l"), F.least(F.lit(1.0), F.lit(float(s.sample)) / F.col("n")).alias("share")))
    chosen = (docs.join(F.broadcast(shares), F.col("lang") == F.col("l"))  # at most s.labels rows
              .where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "t").distinct())  # copies count once

    def run(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, n = _counts(text, s)
                packed = [at.astype("<i4").tobytes(), n.astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([packed[0]], pa.binary()), pa.array([packed[1]], pa.binary())], ["lang", "at", "n"])

    made = checkpoint(chosen.mapInArrow(run, "lang string, at binary, n binary"))
    got = [(r.lang, np.frombuffer(bytes(r.at), "<i4"), np.frombuffer(bytes(r.n), "<i4")) for r in made.toLocalIterator()]
    return sorted(got, key=lambda r: (zlib.crc32(r[1].tobytes()), r[0], r[2].tobytes()))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression by FTRL-proximal with L1 and L2 penalties."""
    z, n = np.zeros((s.buckets + 1, classes)), np.zeros((s.buckets + 1, classes))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        w[np.abs(z[at]) <= s.l1] = 0
        return w

    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, s.buckets), np.append(x, 1.0)
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(s.buckets + 1))
    return w[:-1], w[-1]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", settings: Settings | None = None) -> Model:
    """Fit on the rows that have a language and a text with a letter; a fifth of the sample sets the temperature."""
    s = settings or Settings()
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t")).where("lang is not null and t is not null")
    total, df = document_frequencies(rows.select("t"), s)
    idf = np.log((1 + total) / (1 + df)) + 1
    got = sample(rows, s)
    langs = sorted({lang for lang, _, _ in got})
    if not langs:
        return Model([], np.zeros((s.buckets, 0)), np.zeros(0), 1.0)
    data = [(at, (SCALE * n / n.sum() * idf[at]).astype(np.float32), langs.index(lang)) for lang, at, n in got if len(at)]
    del got
    check, fit = data[::5], [d for i, d in enumerate(data) if i % 5] or data
    w, bias = ftrl(fit, len(langs), s)
    scores = np.array([x @ w[at] + bias for at, x, _ in check])
    truth = np.array([y for _, _, y in check])
    best = min(TEMPERATURES, key=lambda t: _loss(scores / t, truth)) if len(check) else 1.0
    return Model(langs, (w * idf[:, None] * SCALE).astype(np.float64), bias, best)


#: Term frequencies add up to 1; this factor brings features to a size that the step size suits.
SCALE = 10.0
TEMPERATURES = [0.25 * 1.15**k for k in range(25)]


def _loss(scores: np.ndarray, truth: np.ndarray) -> float:
    m = scores.max(axis=1, keepdims=True)
    return float((m[:, 0] + np.log(np.exp(scores - m).sum(axis=1)) - scores[np.arange(len(truth)), truth]).mean())


def predict_text(text: str | None, model: Model, s: Settings) -> tuple[str, float]:
    """(language, probability); ('und', 0) for a text that is null or has no letter, or without any learned language."""
    if not model.langs or not has_letter(text):
        return "und", 0.0
    score, n = np.zeros(len(model.langs)), 0
    for g in _grams(text, s):
        score += np.bincount(g, minlength=s.buckets) @ model.weights if len(g) > 20000 else model.weights[g].sum(axis=0)
        n += len(g)
    z = (score / n + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.langs[int(p.argmax())], float(p.max())


def language_of(text: Column, model: Model, settings: Settings | None = None) -> Column:
    """Struct (lang_pred, score) of a text. Texts alone reach Python, by Arrow batches."""
    s = settings or Settings()
    box = SparkSession.active().sparkContext.broadcast(model)  # buckets x languages numbers

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict_text(t, box.value, s) for t in texts], columns=["lang_pred", "score"])

    return found(text.cast("string"))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """(id, lang_pred, score) of every row, by its whole text alone."""
    return docs.select(F.col(id_col).cast("long").alias("id"), language_of(F.col(text_col), model, settings).alias("found")).select("id", "found.lang_pred", "found.score")


def accepted(docs: DataFrame, model: Model, least: float, text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of docs whose text has a recognised language of at least that probability; columns stay as they were, whatever their names.

    Null texts, texts without letters and unclear ones go. Each repeat of a row is judged alike. An empty table gives an empty result.
    """
    found = unused(docs, "found")
    judged = docs.withColumn(found, language_of(F.col(text_col), model, settings))
    return judged.where((F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.score") >= least)).select(*docs.columns)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id's text modulo 3 is 1 (a null id: not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, with a model learned from the rows that aren't held out.

    Null texts and texts without a letter are 'und' with score 0, as is everything if no row has a
    language. Very long texts are read block by block. Repeated rows are returned each. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    model = train(docs.where(~held_out(id_col)), lang_col, text_col, settings)
    crc = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return predict(docs, model, id_col, text_col, settings).select(F.col("id").alias("doc_id"), crc.alias("held_out"), "lang_pred", "score")
