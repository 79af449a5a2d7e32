"""Quality classifier by hierarchical empirical Bayes over document, path and host evidence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, sized


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows the document classifier is fitted on at most (the bound of the fit's sample)."""

    sample: int = 20_000
    ridge: float = 1e-3
    steps: int = 40
    threshold: float = 0.5
    #: Rows that a parent's rate counts for at least and at most when a site is shrunk towards it.
    strength: tuple[float, float] = (2.0, 1e6)
    #: Sites (about 100 bytes each) that are broadcast at most; beyond, they are joined by a shuffle that AQE splits for hot hosts.
    sites: int = 200_000
    #: Share of the site's log odds that is added to the document's.
    weight: float = 0.25


#: Names of the document features, in the order of `features`.
FEATURES = ("symbols", "upper", "digits", "bars", "shouts", "spaces", "repeats", "word_length", "breaks", "size")


def features(text: Column) -> list[Column]:
    """Numbers that describe a whole text; each is bounded, and null and empty texts have defined ones."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(F.trim(t), "\\s+")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")

    def share(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))) / n

    return [F.sqrt(share("#$%&*@^~_+=<>{}[]\\/")), F.sqrt((F.length(F.regexp_replace(t, "[^\\p{Lu}]+", ""))) / n), F.sqrt(share("0123456789")),
            F.sqrt(share("|")), F.sqrt(share("!?")), share(" "), F.lit(1.0) - F.size(F.array_distinct(words)) / count,
            F.log1p(n / count) / 5, F.sqrt(share("\n")), F.log1p(n) / 15]


def fit(rows: np.ndarray, labels: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of a logistic regression (bias last) by Newton steps with a ridge penalty.

    Without rows of both kinds the weights are zero and the bias is the smoothed rate.
    """
    rate = (labels.sum() + 1) / (len(labels) + 2)
    w = np.zeros(len(FEATURES) + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not 0 < labels.sum() < len(labels):
        return w
    x = np.hstack([rows, np.ones((len(rows), 1))])
    penalty = np.full(x.shape[1], s.ridge * len(rows))
    penalty[-1] = 0
    for _ in range(s.steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (labels - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def strength(moments: list, s: Settings) -> float:
    """Beta prior's weight in rows, by the method of moments from [sites less parents, rows, spread, scale, sum n*r*(1-r)] of all parents.

    Differences between the sites of a parent beyond what their own spread explains make it small, so sites are believed;
    else it is large, so they are shrunk to their parent.
    """
    free, n, spread, scale, inner = (float(v or 0) for v in moments)
    if free < 1 or n <= 0:
        return s.strength[1]
    noise = inner / n  # variance of one row within its site
    between = (spread - free * noise) / max(scale, 1e-9)
    return float(np.clip(noise / between if between > 0 else s.strength[1], *s.strength))


def _moments(table: DataFrame, *parent: str) -> list:
    """What `strength` asks for: each site is measured against the rate of the parent that it is shrunk to, and sums are over parents."""
    r = F.col("s") / F.col("n")
    by = table.groupBy(*parent).agg((F.count("*") - 1).alias("free"), F.sum("n").alias("rows"), (F.sum(F.col("s") * r) - F.sum("s") * F.sum("s") / F.sum("n")).alias("spread"),
                                    (F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("scale"), F.sum("v").alias("inner"))
    return list(by.agg(*[F.sum(c) for c in ("free", "rows", "spread", "scale", "inner")]).first())


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None,
             path: Column | None = None, label_id: str = "doc_id", label_col: str = "quality", settings: Settings | None = None) -> DataFrame:
    """(doc_id, document_score, path_posterior, host_posterior, quality, keep) of every row of docs.

    1. A logistic regression on `features` is fitted on at most settings.sample labelled rows, chosen by a
       hash of their id; it gives each document's probability of being good.
    2. The probabilities of all rows are summed by host and path (partial sums before the shuffle, so a
       site of any size is no task's burden). Hosts are shrunk to the global rate and paths to their
       host's posterior, by weights that the method of moments finds from all sites, each measured against its own parent.
    3. A document's log odds and the shift of its site from the global rate are added. The document itself
       is left out of its site's sum.

    Null hosts and paths are sites of their own. Null and empty texts get what the regression gives their
    features. Labels for unknown ids and null labels are ignored; a repeated label counts once, and so does
    an id that several rows have (the one with the smallest features). Without
    labels of both kinds all rows get the smoothed rate. Very long texts are read whole, repeated rows are returned each. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    s = settings or Settings()
    host = F.lit("") if host is None else host
    path = host if path is None else path
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
                       F.array(*features(F.col(text_col))).alias("x"))
    marks = labels.select(F.col(label_id).cast("long").alias("lid"), F.col(label_col).cast("double").alias("y")).where("lid is not null and y is not null").groupBy("lid").agg(F.max("y").alias("y"))
    total = marks.count()
    if total > s.sample:
        marks = marks.where(F.pmod(F.xxhash64("lid"), F.lit(1 << 30)) < int(s.sample / total * (1 << 30)))
    marks = marks.orderBy(F.pmod(F.xxhash64("lid"), F.lit(1 << 30)), "lid").limit(s.sample)  # the hash leaves about as many; so it's that many at most
    # the features of labelled rows only: the small side decides which texts are looked at
    got = (docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).alias("t")).join(F.broadcast(marks), "lid")
           .select("lid", "y", F.array(*features(F.col("t"))).alias("x")).groupBy("lid").agg(F.min("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("lid"))
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    w = fit(x, (got["y"].to_numpy(float) > 0).astype(float), s)
    logit = F.lit(float(w[-1]))
    for i, v in enumerate(w[:-1]):
        logit = logit + F.col("x")[i] * float(v)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(logit, F.lit(-12.0)), F.lit(12.0))))
    scored = checkpoint(rows.select("doc_id", "host", "path", p.alias("p")))
    paths = scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v"))
    paths = checkpoint(paths)
    hosts = checkpoint(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v")))
    n, good = (float(v or 0) for v in hosts.agg(F.sum("n"), F.sum("s")).first())
    rate = float(np.clip(good / n if n else 0.5, 1e-4, 1 - 1e-4))
    a, b = strength(_moments(hosts), s), strength(_moments(paths, "host"), s)
    sites = (paths.select("host", "path", F.col("n").alias("pn"), F.col("s").alias("ps"))
             .join(hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs")), F.col("host").eqNullSafe(F.col("h")))
             .select(F.col("host").alias("h"), F.col("path").alias("q"), "pn", "ps", "hn", "hs"))
    host_post = (F.col("hs") - F.col("p") + a * rate) / (F.col("hn") - 1 + a)
    path_post = (F.col("ps") - F.col("p") + b * F.col("host_posterior")) / (F.col("pn") - 1 + b)
    odds = lambda c: F.log(c / (F.lit(1.0) - c))
    joined = scored.join(sized(checkpoint(sites), s.sites), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    out = joined.withColumn("host_posterior", host_post).withColumn("path_posterior", path_post)
    within = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    z = odds(within(F.col("p"))) + s.weight * (odds(within(F.col("path_posterior"))) - float(np.log(rate / (1 - rate))))
    out = out.withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return out.select("doc_id", F.col("p").alias("document_score"), "path_posterior", "host_posterior", "quality", (F.col("quality") >= s.threshold).alias("keep"))
