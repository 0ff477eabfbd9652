"""Quality by hierarchical empirical Bayes: evidence of the document, of its host and of its path.

Two classifiers, trained on a bounded sample of labelled documents, give each document the log odds of being of low quality and of being toxic: log odds ratios of hashed
words, shrunk by their standard errors, and a few measures of style enter a logistic regression. Sums of these chances by (host, path) and by host are aggregated. A host's rate is shrunk towards the global rate, a path's rate towards its host's, with strengths
fitted to the spread between sites (method of moments), so sparse sites stay near their parents. The log odds of the path's rate
against the global rate are added to the document's own, and a document is dropped if either posterior chance reaches its threshold, which is set on training rows outside of the folds that described them.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, narrow, schema, write_shared

#: Documents that the classifier is trained on, if there are more labelled ones: a hash class of their ids of 1.1 times so many on average.
SAMPLE = 6_000
BUCKETS = 1 << 20
#: Newton steps at most; standard errors by which a word's log odds are brought towards zero.
ROUNDS, SURE = 40, 3.0
FOLDS = 8
#: A document is dropped from a posterior chance of a half on, or from the chance that so large a share of the negative training rows exceeds, when their own fold is left out.
FALSE_RATE = 0.003
#: The share of the evidence of a site that counts for one document, and the log odds that it may add at most.
SITE_WEIGHT, SITE_MOST = 0.5, 1.0
STYLE = 6
PREFIXES = (4, 6)


def style(text: bytes, words: list[bytes]) -> list[float]:
    """Measures between 0 and 1: marks, bars, capitals, exclamations, digits by length; words that repeat."""
    n = max(1, len(text))
    upper = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = n - len(text.translate(None, b"#*$%&<>"))
    digits = n - len(text.translate(None, b"0123456789"))
    return [min(1.0, 10 * marks / n), min(1.0, 20 * text.count(b"|") / n), upper / n, min(1.0, 20 * text.count(b"!") / n), digits / n, 1 - len(set(words)) / max(1, len(words))]


def features(text: bytes) -> tuple[np.ndarray, list[float]]:
    """The buckets of the distinct words (A-Z lower-cased, without marks) and of their beginnings of PREFIXES bytes, and the style."""
    words = text.lower().translate(None, b"!#*$%&|<>.,;:?\"()").split()
    own = set(words)
    parts = [own, *[{w[:k] + b"~" for w in own if len(w) > k} for k in PREFIXES]]
    return np.fromiter({zlib.crc32(w) % BUCKETS for p in parts for w in p}, dtype=np.int32), style(text, words)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Log odds from a document's words and style. w: each bucket's shrunk log odds ratio; v: of the logistic regression over the sums of w above and below zero, the largest w, and the style."""

    def __init__(self, w: np.ndarray, v: np.ndarray, limit: float = 0.5):
        self.w, self.v, self.limit = w.astype(np.float32), v, limit

    def __call__(self, buckets: np.ndarray, measures: list[float]) -> float:
        return float(np.dot(self.v, inputs(self.w, buckets, measures)))


def inputs(w: np.ndarray, buckets: np.ndarray, measures: list[float]) -> np.ndarray:
    x = w[buckets]
    return np.array([x[x > 0].sum(), x[x < 0].sum(), x.max(initial=0.0), *measures, 1.0])


def word_odds(rows: list[tuple[np.ndarray, list[float]]], y: np.ndarray) -> np.ndarray:
    """For each bucket the log odds ratio of the documents that hold it, brought towards zero by SURE standard errors: words seen in few documents count for nothing."""
    n = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for c in (0, 1):
        own = [r[0] for r, k in zip(rows, y) if k == c]
        if own:
            n[c] = np.bincount(np.concatenate(own), minlength=BUCKETS).astype(float)
    total = [float((y == c).sum()) for c in (0, 1)]
    ratio = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
    error = np.sqrt(1 / (n[1] + 0.5) + 1 / (n[0] + 0.5))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - SURE * error, 0) * ((n[0] + n[1]) > 0)


def train(rows: list[tuple[np.ndarray, list[float]]], labels: np.ndarray) -> Model:
    """Each fold of the rows is described by word odds of the other folds; on that the regression is fitted by Newton's method and the threshold is set. New documents are described by word odds of all rows."""
    y = labels.astype(float)
    size = STYLE + 4
    if len(rows) < FOLDS or y.min() == y.max():
        return Model(np.zeros(BUCKETS), np.array([0.0] * (size - 1) + [6.0 if len(rows) and y.min() == 1 else -6.0]))
    fold = np.arange(len(rows)) % FOLDS
    x = np.empty((len(rows), size))
    for k in range(FOLDS):
        w = word_odds([r for r, f in zip(rows, fold) if f != k], y[fold != k])
        for i in np.flatnonzero(fold == k):
            x[i] = inputs(w, *rows[i])
    scale = np.sqrt((x * x).mean(axis=0)) + 1e-6
    x = x / scale
    v = np.zeros(size)
    ridge = np.diag([1.0] * (size - 1) + [1e-3])
    for _ in range(ROUNDS):
        p = _sigmoid(x @ v)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ v)
        v = v + step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    clean = np.sort(_sigmoid(x @ v)[y == 0])[::-1]
    limit = max(0.5, float(clean[min(len(clean) - 1, int(FALSE_RATE * len(clean)))]) + 1e-9)
    return Model(word_odds(rows, y), v / scale, limit)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Model, Model]:
    """Models of low quality and of toxicity, from labelled documents: all of them up to sample, or a hash class of them. Of labels that conflict the worst holds. The order of rows doesn't matter."""
    own = narrow(labels, k="doc_id", quality="quality", toxic="toxic").where("k is not null")
    own = own.groupBy("k").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("k"))
    n = own.count()
    own = own.where(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, 1.1 * sample / max(1, n)) * (1 << 30)))

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            got = [features((t or "").encode("utf-8", "replace")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([np.array(g[1]).tobytes() for g in got], pa.binary()), batch.column(1), batch.column(2)], names=["b", "s", "low", "toxic"])

    joined = narrow(docs, k=id_col, text=text_col).join(own, "k").select("text", (F.col("quality") == 0).alias("low"), (F.col("toxic") == 1).alias("toxic"))
    rows = joined.mapInArrow(measure, schema(b="binary", s="binary", low="boolean", toxic="boolean")).collect()
    rows.sort(key=lambda r: (zlib.crc32(r.b + r.s), r.b, r.s, str(r.low), str(r.toxic)))  # folds go by position
    data = [(np.frombuffer(r.b, dtype=np.int32), np.frombuffer(r.s).tolist()) for r in rows]
    heads = []
    for head in ("low", "toxic"):
        known = [k for k, r in enumerate(rows) if r[head] is not None]
        heads.append(train([data[k] for k in known], np.array([rows[k][head] for k in known], dtype=bool)))
    return heads[0], heads[1]


def scored(df: DataFrame, models: tuple[Model, Model], text_col: str = "text", low: str = "low_odds", toxic: str = "toxic_odds", columns: list[str] | None = None) -> DataFrame:
    """df (or some of its columns) with the log odds of both models. The models are a broadcast of fixed size."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(models)
    kept = columns if columns is not None else df.columns
    source = df.select(*[f"`{c}`" for c in kept], F.col(f"`{text_col}`").alias("\x01text"))
    target = T.StructType([*df.select(*[f"`{c}`" for c in kept]).schema.fields, T.StructField(low, T.DoubleType()), T.StructField(toxic, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            odds = []
            for t in batch.column(len(kept)).cast(pa.binary()).to_pylist():
                buckets, measures = features(t or b"")
                odds.append([m(buckets, measures) for m in shared.value])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(kept))] + [pa.array([o[k] for o in odds], pa.float64()) for k in (0, 1)], names=target.names)

    return source.mapInArrow(run, target)


def _strength(rows: DataFrame, n: str, k: str, parent: str) -> float:
    """Pseudo-counts of the prior of groups with n rows and a sum of chances k around their parents' rates; 1e6 if they spread no more than by chance."""
    p, m, s = F.col(parent), F.col(n), F.col(k)
    v = p * (1 - p)
    t = rows.agg(F.sum((s - m * p) * (s - m * p) / m).alias("spread"), F.sum(v).alias("chance"), F.sum(m * v).alias("total")).first()
    if not t.total or t.spread is None or t.spread <= t.chance:
        return 1e6
    return max(1.0, t.total / (t.spread - t.chance) - 1)


def site_rates(odds: DataFrame, names: tuple[str, ...] = ("low", "toxic")) -> DataFrame:
    """host, path and for each name <name>_shift: the log odds of the path's shrunk rate against the global rate. odds: host, path, <name>_odds."""
    chance = lambda c: 1 / (1 + F.exp(-F.col(c)))
    paths = write_shared(odds.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(chance(f"{x}_odds")).alias(x) for x in names]), "paths")
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("hn"), *[F.sum(x).alias(f"h_{x}") for x in names])
    total = hosts.agg(F.sum("hn"), *[F.sum(f"h_{x}") for x in names]).first()
    if not total[0]:
        return paths.select("host", "path", *[F.lit(0.0).alias(f"{x}_shift") for x in names])
    rates = {x: min(max(total[k + 1] / total[0], 1e-6), 1 - 1e-6) for k, x in enumerate(names)}
    for x in names:
        hosts = hosts.withColumn("g", F.lit(rates[x]))
        s = _strength(hosts, "hn", f"h_{x}", "g")
        hosts = hosts.withColumn(f"rate_{x}", (F.col(f"h_{x}") + F.lit(rates[x] * s)) / (F.col("hn") + s))
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    for x in names:
        s = _strength(both, "n", x, f"rate_{x}")
        rate = (F.col(x) + F.col(f"rate_{x}") * s) / (F.col("n") + s)
        rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
        shift = F.log(rate / (1 - rate)) - F.lit(float(np.log(rates[x] / (1 - rates[x]))))
        both = both.withColumn(f"{x}_shift", F.least(F.greatest(shift * SITE_WEIGHT, F.lit(-SITE_MOST)), F.lit(SITE_MOST)))
    return both.select("host", "path", *[f"{x}_shift" for x in names])


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", models: tuple[Model, Model] | None = None) -> DataFrame:
    """df with all its columns, and p_low, p_toxic (posterior chances) and kept, or these names with underscores where df has them.

    A null text is empty and judged so; null hosts or paths make up a host or path of their own. Rows that repeat are each judged and counted; an empty table gives none, without labels nothing is dropped.
    Texts are scored twice and never shuffled for it: once for the site table, whose rates are then joined to the second scoring by Catalyst's choice (broadcast if small, else a shuffle that splits hot sites).
    """
    models = models or fit(df, labels, id_col, text_col)
    source = df.select("*", F.col(f"`{host_col}`").alias("\x01host"), F.col(f"`{path_col}`").alias("\x01path"))
    odds = scored(source, models, text_col, columns=["\x01host", "\x01path"]).select(F.col("`\x01host`").alias("host"), F.col("`\x01path`").alias("path"), "low_odds", "toxic_odds")
    sites = write_shared(site_rates(odds), "sites")
    low, toxic, kept = fresh(df, "p_low"), fresh(df, "p_toxic"), fresh(df, "kept")
    rows = scored(source, models, text_col, "\x01low", "\x01toxic")
    sites = sites.select(F.col("host").alias("\x02host"), F.col("path").alias("\x02path"), F.col("low_shift").alias("\x02low"), F.col("toxic_shift").alias("\x02toxic"))
    both = rows.join(sites, F.col("`\x01host`").eqNullSafe(F.col("`\x02host`")) & F.col("`\x01path`").eqNullSafe(F.col("`\x02path`")), "left")
    chance = lambda x: 1 / (1 + F.exp(-(F.col(f"`\x01{x}`") + F.coalesce(f"`\x02{x}`", F.lit(0.0)))))
    both = both.withColumns({low: chance("low"), toxic: chance("toxic")})
    both = both.withColumn(kept, ~((F.col(low) >= models[0].limit) | (F.col(toxic) >= models[1].limit)))
    return both.select(*[f"`{c}`" for c in df.columns], low, toxic, kept)
