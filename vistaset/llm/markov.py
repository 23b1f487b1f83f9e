"""Hidden Markov language model: Baum-Welch over all training documents, exact scaled forward scores.

Words fall into a fixed number of classes: the most frequent words one each, all others by a hash of
their ending, and the end of a document one. States emit classes, and a class emits its words by
smoothed relative frequency, so the model is a proper distribution over texts, its tables are of fixed
size, and word counts (one row per distinct word, never collected) grow with the corpus. Each
Baum-Welch pass sums expected counts per task, then over tasks; the driver sees states x classes.

Frequent words' counts are broadcast (a bounded number of words of bounded length); all others join the
count table by word, once per document. A document's likelihood is exact: long documents are cut into segments whose
transfer matrices are chained. For training, segments are sequences of their own.

Defined results: null and empty texts hold the end alone; without training rows every probability is
that of the smoothed empty table; repeated rows are scored row by row; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, own_columns, table, written

STATES, ROUNDS = 8, 5
#: Words with a class each, words whose counts are broadcast, classes of word endings, bytes of a broadcast word.
OWN, TOP, ENDINGS, WORD_BYTES = 4096, 131_072, 2048, 64
END = OWN + ENDINGS
CLASSES = END + 1
SEGMENT = 1024
BATCH_TOKENS = 1_000_000


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def _counts(batches):
    def out(n):
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "c"])

    n: Counter = Counter()
    for b in batches:
        for t in b.column("text").to_pylist():
            n.update(tokens(t))
        if len(n) > 500_000:
            yield out(n)
            n = Counter()
    yield out(n)


class Codes(dict):
    """Word to rank among the broadcast words, or -1 - ending class."""

    def __missing__(self, word: bytes) -> int:
        return -1 - ending(word)


@dataclass
class Vocabulary:
    """Corpus totals, the broadcast words, and the smoothed size of each ending class."""

    n: int
    v: int
    ends: int
    words: list[bytes]
    counts: np.ndarray
    class_norm: np.ndarray

    def classes(self) -> np.ndarray:
        """Class of each broadcast word by rank."""
        return np.array([i if i < OWN else OWN + ending(w) for i, w in enumerate(self.words)], np.int64)


def _most_frequent(counts: DataFrame) -> list:
    """Words above the least count of which TOP words at most are that frequent, by falling count, then by word.

    A histogram of counts (exact to 1024, then 64 steps to each doubling) gives the cut, so what reaches the
    driver is bounded whatever the number of partitions.
    """
    c = F.col("c")
    level = F.when(c <= 1024, c).otherwise(1024 + F.floor(64 * F.log2(c / 1024)))
    cut, n = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        n += r["count"]
        if n > TOP:
            break
        cut = r["level"]
    rows = counts.where(level >= cut).collect() if cut is not None else []
    return sorted(rows, key=lambda r: (-r["c"], bytes(r["word"])))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = _most_frequent(counts.where(F.octet_length("word") <= WORD_BYTES))
    words, n = [bytes(r["word"]) for r in top], np.array([r["c"] for r in top], np.int64)
    own = set(words[:OWN])

    def sums(batches):
        s = np.zeros((ENDINGS, 2))
        for b in batches:
            w = b.column("word").to_pylist()
            keep = np.array([x not in own for x in w], bool)
            k = np.array([ending(x) for x in w], np.int64)[keep]
            s[:, 0] += np.bincount(k, b.column("c").to_numpy()[keep], ENDINGS)
            s[:, 1] += np.bincount(k, minlength=ENDINGS)
        yield pa.RecordBatch.from_pydict({"k": np.arange(ENDINGS), "n": s[:, 0], "v": s[:, 1]})

    norm = np.full(ENDINGS, 1.0 * 0.5)
    for r in counts.mapInArrow(sums, "k long, n double, v double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        norm[r["k"]] = r["n"] + 0.5 * (r["v"] + 1)
    return Vocabulary((total["n"] or 0) + ends, total["v"] + (ends > 0), ends, words, n, norm)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Class sequences: uid, doc_id, held_out, n_words, classes, sums over frequent words, the other words."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab.words, vocab.counts, vocab.classes()))

    def done(batches):
        words, counts, classes = sent.value
        codes = Codes(zip(words, range(len(words)), strict=True))
        logs = np.append(np.log10(counts + 0.5), 0.0)
        classes = np.append(classes, 0)
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                w = tokens(t)
                c = np.fromiter(map(codes.__getitem__, w), np.int64, len(w))
                rare = np.flatnonzero(c < 0)
                k = np.where(c < 0, OWN - 1 - c, classes[np.maximum(c, 0)])
                x = logs[np.maximum(c, 0)] * (c >= 0)
                own = k < OWN
                out.append((len(w), k.astype("<u2").tobytes(), x[own].sum(), x[~own].sum(), [w[i] for i in rare]))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.binary())]
            uid = pa.array(range((part << 40) + at, (part << 40) + at + len(out)), pa.int64())
            at += len(out)
            yield pa.RecordBatch.from_arrays(
                [uid, b.column("doc_id"), b.column("held_out"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["uid", "doc_id", "held_out", "n_words", "classes", "own_sum", "ending_sum", "rare"],
            )

    schema = "uid long, doc_id long, held_out boolean, n_words long, classes binary, own_sum double, ending_sum double, rare array<binary>"
    return docs.mapInArrow(done, schema)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states

    @staticmethod
    def first(class_n: np.ndarray, seed: int = 5) -> Model:
        """Sticky states whose emissions are the corpus frequencies with seeded noise."""
        r = np.random.default_rng(seed)
        emit = (class_n[:, None] + 0.5) * np.exp(r.normal(0, 1, (CLASSES, STATES)))
        move = np.full((STATES, STATES), 0.05 / (STATES - 1)) + np.eye(STATES) * (0.95 - 0.05 / (STATES - 1))
        return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @staticmethod
    def of(start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_n: np.ndarray) -> Model:
        """From expected counts; each state's emissions are smoothed towards the corpus frequencies."""
        prior = (class_n + 0.5) / (class_n + 0.5).sum()
        emit = emit + 200.0 * prior[:, None]
        move, start = move + 0.1, start + 0.1
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def stationary(self) -> np.ndarray:
        v = np.full(STATES, 1 / STATES)
        for _ in range(200):
            v = v @ self.move
        return v / v.sum()

    def forward(self, seqs: list[np.ndarray], first: np.ndarray, keep: bool = False):
        """Scaled forward recursion of many sequences at once, longest first.

        ``first``: the state distribution at each sequence's first token. Returns log10 likelihoods,
        last normalised vectors and, if kept, all vectors by step.
        """
        sizes = np.array([len(s) for s in seqs])
        n, steps = len(seqs), int(sizes[0]) if len(seqs) else 0
        flat, begin = np.concatenate(seqs) if n else np.zeros(0, int), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # sequences longer than t
        total, last, all_ = np.zeros(n), first.copy(), []
        for t in range(steps):
            k = alive[t]
            a = (last[:k] @ self.move if t else first[:k]) * self.emit[flat[begin[:k] + t]]
            s = a.sum(1)
            a /= s[:, None]
            total[:k] += np.log10(s)
            last[:k] = a
            if keep:
                all_.append((a, s))
        return total, last, all_, flat, begin, alive


def _segments(classes: bytes) -> list[np.ndarray]:
    a = np.append(np.frombuffer(classes, "<u2").astype(np.int64), END)
    return [a[i : i + SEGMENT] for i in range(0, len(a), SEGMENT)]


def expected(batches, model: Model):
    """Expected counts of one task: a row of start and move counts, then a row per state of class counts."""
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
    rest = model.stationary()

    def add(seqs):
        seqs.sort(key=lambda s: -len(s[0]))
        first = np.array([model.start if f else rest for _, f in seqs])
        _, _, kept, flat, begin, alive = model.forward([s for s, _ in seqs], first, keep=True)
        beta = np.ones((len(seqs), STATES))
        for t in range(len(kept) - 1, -1, -1):
            k, (a, s) = alive[t], kept[t]
            g = a * beta[:k]
            g /= g.sum(1, keepdims=True)
            c = flat[begin[:k] + t]
            for j in range(STATES):
                emit[j] += np.bincount(c, g[:, j], CLASSES)
            if t:
                b = model.emit[c] * beta[:k] / s[:, None]
                move[:] += model.move * (kept[t - 1][0][:k].T @ b)
                beta[:k] = b @ model.move.T
            else:
                start[:] += g[[i for i, (_, f) in enumerate(seqs) if f]].sum(0)

    waiting, n = [], 0
    for b in batches:
        for c in b.column("classes").to_pylist():
            for i, s in enumerate(_segments(c)):
                waiting.append((s, i == 0))
                n += len(s)
                if n >= BATCH_TOKENS:
                    add(waiting)
                    waiting, n = [], 0
    if waiting:
        add(waiting)
    data = [np.concatenate([start, move.ravel()]), *emit]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array([d.tolist() for d in data], pa.list_(pa.float64()))], ["part", "x"])


def _class_counts(batches):
    n = np.zeros(CLASSES, np.int64)
    for b in batches:
        for c in b.column("classes").to_pylist():
            n += np.bincount(np.frombuffer(c, "<u2"), minlength=CLASSES)
            n[END] += 1
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n.astype(float).tolist()], pa.list_(pa.float64()))], ["part", "x"])


def _add(batches):
    """Sum the vectors of each part within a partition."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("part").to_pylist(), b.column("x"), strict=True):
            v = x.values.to_numpy(zero_copy_only=False)
            sums[k] = sums[k] + v if k in sums else v.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["part", "x"])


def _summed(df: DataFrame) -> dict[int, np.ndarray]:
    """Vectors added by part: first in 32 groups of tasks, then over the groups."""
    schema, parts = "part int, x array<double>", STATES + 1
    groups = df.withColumn("salt", F.spark_partition_id() % 32).repartition(4 * parts, "part", "salt")
    done = groups.select("part", "x").mapInArrow(_add, schema).repartition(parts, "part").mapInArrow(_add, schema)
    return {r["part"]: np.array(r["x"]) for r in done.collect()}


def train(encoded: DataFrame, rounds: int = ROUNDS) -> Model:
    own = encoded.where(~F.col("held_out")).select("classes")
    class_n = _summed(own.mapInArrow(_class_counts, "part int, x array<double>")).get(0, np.zeros(CLASSES))
    model = Model.first(class_n)
    for _ in range(rounds):
        found = _summed(own.mapInArrow(lambda b, m=model: expected(b, m), "part int, x array<double>"))
        if not found:
            break
        model = Model.of(found[0][:STATES], found[0][STATES:].reshape(STATES, STATES), np.array([found[1 + j] for j in range(STATES)]).T, class_n)
    return model


def log_likelihoods(sequences: list[bytes], model: Model) -> np.ndarray:
    """Exact log10 likelihood of each class sequence with its end."""
    out = np.zeros(len(sequences))
    rows, first, of = [], [], []
    for i, c in enumerate(sequences):
        for j, s in enumerate(_segments(c)):
            for k in range(1 if j == 0 else STATES):
                rows.append(s)
                first.append(model.start if j == 0 else model.move[k])
                of.append((i, j, k))
    order = np.argsort([-len(s) for s in rows], kind="stable")
    total, last, *_ = model.forward([rows[i] for i in order], np.array([first[i] for i in order]).reshape(-1, STATES))
    back = np.argsort(order)
    total, last = total[back], last[back]
    at = 0
    while at < len(of):
        i, j, _ = of[at]
        if j == 0:
            out[i], v = total[at], last[at]
            at += 1
        else:
            t = total[at : at + STATES]
            top = t.max()
            u = (v * 10 ** (t - top)) @ last[at : at + STATES]
            out[i] += top + math.log10(u.sum())
            v = u / u.sum()
            at += STATES
    return out


def score(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    norm, classes_log = math.log10(vocab.n + 0.5 * (vocab.v + 1)), np.zeros(CLASSES)
    classes_log[OWN:END] = np.log10(vocab.class_norm)

    def done(batches):
        for b in batches:
            c = b.column("classes").to_pylist()
            hidden, norms, i = np.zeros(len(c)), np.array([classes_log[np.frombuffer(x, "<u2")].sum() for x in c]), 0
            while i < len(c):
                j, n = i, 0
                while j < len(c) and (j == i or n < BATCH_TOKENS // 4):
                    n += len(c[j]) // 2
                    j += 1
                hidden[i:j] = log_likelihoods(c[i:j], model)
                i = j
            keep = [b.column(k) for k in ("uid", "doc_id", "held_out", "n_words", "own_sum", "ending_sum", "n_rare")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(hidden - norms)], ["uid", "doc_id", "held_out", "n_words", "own_sum", "ending_sum", "n_rare", "hidden"])

    docs = encoded.select("uid", "doc_id", "held_out", "n_words", "classes", "own_sum", "ending_sum", F.size("rare").cast("long").alias("n_rare"))
    docs = docs.mapInArrow(done, "uid long, doc_id long, held_out boolean, n_words long, own_sum double, ending_sum double, n_rare long, hidden double")
    # a document's repeats of a word are one row before they meet its count
    words = encoded.select("uid", F.explode("rare").alias("word")).groupBy("uid", "word").agg(F.count(F.lit(1)).alias("times"))
    rare = words.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_sum"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("rare_known")
    )
    out = docs.join(rare, "uid", "left").select("*", F.coalesce("rare_sum", F.lit(0.0)).alias("rs"), F.coalesce("rare_known", F.lit(0)).alias("rk"))
    n_tokens = F.col("n_words") + 1
    end = math.log10(vocab.ends + 0.5)
    return out.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_words") - F.col("n_rare") + F.col("rk") + int(vocab.ends > 0)).cast("long").alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("own_sum") + F.col("ending_sum") + F.col("rs") + F.lit(end) - n_tokens * F.lit(norm)).alias("base_score"),
        (F.col("hidden") + F.col("ending_sum") + F.col("rs")).alias("score"),
    )


def score_documents(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    own = own.withColumn("held_out", crc_mod(F.col("doc_id"), folds) == held)
    seen = own.where(~F.col("held_out"))
    counts = written(seen.select("text").mapInArrow(_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    vocab = vocabulary(counts, seen.select("doc_id").count())
    encoded = written(encode(own, vocab), "classes")
    return score(encoded, counts, vocab, train(encoded))


def op3_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
