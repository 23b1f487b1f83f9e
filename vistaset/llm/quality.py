"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text is reduced to a fixed vector of log-transformed statistics. Class moments (count,
sum, outer products) are summed per task and then over tasks, so training reads all labelled rows
and only ``classes x (p^2 + p + 1)`` numbers reach the driver. Each class covariance is shrunk
towards the pooled one and that towards its mean variance; scores come from the difference of
Mahalanobis log-densities with the inverse Cholesky factors computed once.

Defined results: null and empty texts have all-zero counts and are scored like any other; repeated
ids are scored row by row; a doc_id with several labels counts once per label row; null labels are
ignored; with one class only, or none, every score is that class's prior (0.5 without labels); very
long texts are read whole; equal scores are kept or rejected alike; extra columns are carried, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, own_columns, table, written

#: Byte classes: u upper, l lower or non-ASCII, d digit, s blank, n newline, p sentence mark, y other symbol.
_CLASSES = bytes(
    ord("n") if c == 10 else ord("s") if c == 32 or 9 <= c <= 13 else ord("d") if 48 <= c <= 57
    else ord("u") if 65 <= c <= 90 else ord("l") if 97 <= c <= 122 or c >= 128
    else ord("p") if chr(c) in ".,;:'\"?-()" else ord("y")
    for c in range(256)
)
FEATURES = (
    "log_words", "word_length", "symbols", "uppers", "digits", "marks", "distinct", "repeats",
    "newlines", "repeated_lines", "short_words", "top_word", "non_ascii",
)


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES."""
    text = text or b""
    kinds, words = text.translate(_CLASSES), text.split()
    n, chars, lines = len(words), len(text), text.split(b"\n")
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    share = lambda x, of: math.log((x + 0.5) / (of + 1))
    return [
        math.log1p(n),
        math.log1p(chars / max(n, 1)),
        share(kinds.count(b"y"), chars),
        share(kinds.count(b"u"), chars),
        share(kinds.count(b"d"), chars),
        share(kinds.count(b"p"), n),
        share(len(seen), n),
        share(sum(map(eq, words, words[1:])), n),
        share(kinds.count(b"n"), n),
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(v for w, v in seen.items() if len(w) <= 3), n),
        share(max(seen.values(), default=0), n),
        share(len(text) - len(text.translate(None, bytes(range(128, 256)))), chars),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and log-priors of the two classes."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    priors: np.ndarray

    @staticmethod
    def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooling: float, ridge: float) -> Discriminant:
        p = len(FEATURES)
        zero = (0.0, np.zeros(p), np.zeros((p, p)))
        (n0, s0, q0), (n1, s1, q1) = (moments.get(k, zero) for k in (0, 1))
        n = n0 + n1
        centre = (s0 + s1) / max(n, 1)
        scale = np.sqrt(np.maximum(np.diag(q0 + q1) / max(n, 1) - centre**2, 1e-9))
        cov, means = [], []
        for k, s, q in ((n0, s0, q0), (n1, s1, q1)):
            m = s / k if k else centre
            means.append((m - centre) / scale)
            c = q / k - np.outer(m, m) if k else np.zeros((p, p))
            cov.append(c / np.outer(scale, scale))
        pooled = (n0 * cov[0] + n1 * cov[1]) / max(n, 1)
        factors, logdets = [], []
        for c in cov:
            c = (1 - pooling) * c + pooling * pooled
            c = (1 - ridge) * c + ridge * max(np.trace(c) / p, 1e-3) * np.eye(p)
            low = np.linalg.cholesky(c)
            factors.append(np.linalg.inv(low))
            logdets.append(2 * np.log(np.diag(low)).sum())
        priors = np.log([(n0 + 0.5) / (n + 1), (n1 + 0.5) / (n + 1)])
        if not n0 or not n1:  # nothing to tell apart: the prior alone decides
            means, factors = [means[0] * 0] * 2, [factors[0] * 0] * 2
            logdets = [0.0, 0.0]
            priors = np.log([0.5, 0.5]) if not n else priors
        return Discriminant(centre, scale, *map(np.array, (means, factors, logdets)), priors)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row of statistics."""
        z = (x - self.centre) / self.scale
        d = [
            self.priors[k] - 0.5 * self.logdets[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(1)
            for k in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def _vectors(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    for b in batches:
        x = [statistics(t.as_py()) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], schema=schema)


def _moments(batches):
    p, sums = len(FEATURES), {}
    for b in batches:
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        y = b.column("quality").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            add = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
            sums[k] = sums.get(k, 0) + add
    if sums:
        yield pa.RecordBatch.from_pydict({"quality": pa.array(list(sums), pa.int32()), "m": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, one row per row of ``docs``."""
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(_vectors, "doc_id long, x array<double>")


def train(stats: DataFrame, labels: DataFrame, pooling: float = 0.1, ridge: float = 0.02, folds: int = 5) -> Discriminant:
    """Fit on the labelled rows whose crc32(doc_id) modulo ``folds`` is not 0."""
    y = own_columns(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1))
    y = y.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(crc_mod(F.col("doc_id"), folds) != 0)
    found = stats.join(y, "doc_id").select("x", "quality").mapInArrow(_moments, "quality int, m array<double>")
    p = len(FEATURES)
    size = 1 + p + p * p
    sums = found.groupBy("quality").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m")).collect()
    of = {r["quality"]: np.array(r["m"]) for r in sums}
    return Discriminant.fit({k: (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)) for k, v in of.items()}, pooling, ridge)


def score_statistics(stats: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    def scored(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    out = stats.select("doc_id", "x").mapInArrow(scored, "doc_id long, score double")
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``."""
    names, at = docs.columns, docs.columns.index("text")
    d = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def kept(batches):
        for b in batches:
            # the text travels once; each is looked at alone
            x = [statistics(t.as_py()) for t in b.column(at).cast(pa.binary())]
            yield b.filter(pa.array(model.score(np.array(x).reshape(-1, len(FEATURES))) >= threshold))

    return d.mapInArrow(kept, d.schema).toDF(*names)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(statistics_table(table(spark, sf_dir, "documents")), "quality")
    return score_statistics(stats, train(stats, table(spark, sf_dir, "labels")))
