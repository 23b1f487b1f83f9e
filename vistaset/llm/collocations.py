"""Operator 12: phrases of two to four words whose parts are seldom seen apart, for each language.

Counts are exact and cover all texts. n-grams become rows length by length and are summed per (language,
phrase). A phrase of n words can only reach the least count where both of its parts of n - 1 words do, so
each length is exploded only where the counts of the length before allow it: these counts are told to the
tasks as a bitmap of phrase hashes of fixed size. A hash that meets another one's bit lets a phrase through
that its count drops later; none is lost, at any size. Scores, cuts and extensions are joins of the counted
phrases; scores are exact decimals. A phrase within a phrase two words longer also lies within one that is
one word longer and at least as frequent, so extensions by one word decide.

Defined cases: a null text is empty, a null language is ``und`` and counts with a language of that name,
an empty language is a language; repeated rows count each; texts without words add nothing; ties in score
and count go by the phrase's bytes; no rows give no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_of, forget, own_columns, released, table, written

#: Words of the longest phrase, least count, share of the count (in per cent) at which a longer phrase replaces it, places.
LONGEST, LEAST, ABSORBED, PLACES = 4, 30, 80, 2000
SCORE = 2_000_000
#: Bytes of text whose words are numbered and counted together.
CHUNK = 8 << 20
#: The bitmap has 2^27 bits (16 MiB) at every size.
BITS = 27
#: Upper to lower case, ends of pieces to line feeds, tabs to spaces.
_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "lang string, phrase string, f long"


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of texts in order, a 1 between pieces, and the words by number; 0 is the empty word."""
    # each word keeps the space behind it, so words are slices of one buffer that Arrow numbers
    data = b" \n " + b"\n".join(texts).translate(_TO).replace(b"\n", b" \n ") + b" "
    ends = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    ids = found.indices.to_numpy()[2:].astype(np.int64)
    return ids[ids > 0], [w[:-1] for w in found.dictionary.to_pylist()]


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    within = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    each = _stirred((data + np.uint64(1)) * _MIX + within.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
    ends = np.cumsum(size)
    return _stirred(total[ends] - total[ends - size] + size.astype(np.uint64))


def bits_of(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """Places in the bitmap of phrases given by the hashes of their words."""
    h = np.full(len(hashes[0]), word_hashes([lang.encode()])[0])
    for w in hashes:
        h = _stirred(h * _MIX + w)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _by_language(batches):
    """Texts of a partition in chunks, by language."""
    held, size = {}, 0
    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
            data = text.encode()
            held.setdefault(lang, []).append(data)
            size += len(data) + 1
            if size >= CHUNK:
                yield held
                held, size = {}, 0
    if held:
        yield held


def grams(docs: DataFrame, n: int, sieve: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f): every phrase of ``n`` words that the sieve of shorter ones allows, counted by chunk."""
    spread = None if sieve is None else docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches):
        for chunk in _by_language(batches):
            for lang, texts in chunk.items():
                ids, words = numbered_words(texts)
                if n == 1:
                    f = np.bincount(ids, minlength=len(words))
                    f[1] = 0
                    some = np.flatnonzero(f)
                    yield _rows(lang, pa.array([words[i] for i in some], pa.binary()), f[some])
                    continue
                at = np.flatnonzero(ids > 1)
                for k in range(1, n):
                    at = at[at < len(ids) - k]
                    at = at[ids[at + k] > 1]
                hashes = word_hashes(words)
                for k in (0, 1):
                    bit = bits_of(lang, [hashes[ids[at + k + j]] for j in range(n - 1)])
                    at = at[spread.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0]
                code = ids[at]
                for k in range(1, n):
                    # codes of the first words, made dense, times the number of words: exact for any length
                    code = np.unique(code, return_inverse=True)[1] * len(words) + ids[at + k]
                spelled = pa.array(words, pa.binary())
                _, first, f = np.unique(code, return_index=True, return_counts=True)
                for i in range(0, len(first), 1 << 18):
                    parts = [spelled.take(pa.array(ids[at[first[i : i + (1 << 18)]] + k])) for k in range(n)]
                    yield _rows(lang, pc.binary_join_element_wise(*parts, b" "), f[i : i + (1 << 18)])
        released()

    return docs.mapInArrow(run, _SCHEMA)


def _rows(lang: str, phrases: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(f.astype(np.int64))], ["lang", "phrase", "f"])


def sieve(frequent: DataFrame) -> np.ndarray:
    """The bitmap of frequent phrases: pieces of 4 KiB are made on the executors, at most 16 MiB meet."""

    def run(batches):
        for b in batches:
            langs = np.array(b["lang"].to_pylist(), object)
            parts = [p.encode().split(b" ") for p in b["phrase"].to_pylist()]
            for lang in set(langs):
                hashes = [word_hashes(list(w)) for w in zip(*[parts[i] for i in np.flatnonzero(langs == lang)], strict=True)]
                bit = bits_of(lang, hashes)
                yield pa.RecordBatch.from_arrays([pa.array((bit >> 15).astype(np.int32)), pa.array(bit & 32767)], ["piece", "bit"])

    made = frequent.select("lang", "phrase").mapInArrow(run, "piece int, bit long").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in made.collect():
        out[r["piece"] << 12 : (r["piece"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to ``longest`` words found ``least`` times, and (lang, n) of all words.

    The parts of a phrase are found at least as often as it, so they are among them.
    """
    texts = own_columns(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = written(grams(texts, 1, None).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    totals = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    levels = [written(words.where(F.col("f") >= least), "phrases")]
    forget(words)
    for n in range(2, longest + 1):
        found = grams(texts, n, sieve(levels[-1])).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        levels.append(written(found.where(F.col("f") >= least), "phrases"))
    out = None
    for n, level in enumerate(levels, 1):
        level = level.withColumn("words", F.lit(n))
        out = level if out is None else out.unionByName(level)
    return out, totals


def _head(words, k):
    return F.array_join(F.slice(words, F.lit(1), k), " ")


def _tail(words, k):
    return F.array_join(F.slice(words, k + 1, F.size(words) - k), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words and more, by their lowest-scoring cut."""
    ws = F.split("phrase", " ")
    cut = phrases.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", "words", F.col("f").alias("a"), "k", _head(ws, F.col("k")).alias("_h"), _tail(ws, F.col("k")).alias("_t"))
    known = phrases.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias("_f"))
    left, right = known.alias("h"), known.alias("t")
    both = cut.join(left, (F.col("lang") == F.col("h._l")) & (F.col("_h") == F.col("h._p"))).join(right, (F.col("lang") == F.col("t._l")) & (F.col("_t") == F.col("t._p")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    s = both.withColumn("l", F.col("h._f")).withColumn("r", F.col("t._f")).withColumn("_n", wide("a") * SCORE).withColumn("_d", wide("l") + wide("r"))
    s = s.withColumn("score", F.expr("_n div _d").cast("long"))
    best = s.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "b.score")


def whole(candidates: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """Candidates that no longer one replaces."""
    ws = F.split("phrase", " ")
    longer = candidates.where("words > 2").withColumn("_w", F.explode(F.array(_head(ws, F.col("words") - 1), _tail(ws, F.lit(1)))))
    longer = longer.groupBy(F.col("lang").alias("_l"), F.col("_w")).agg(F.max("a").alias("_a"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return candidates.join(longer, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_w")) & (wide("_a") * 100 >= wide("a") * absorbed), "left_anti")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, absorbed: int = ABSORBED, places: int = PLACES) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    phrases, totals = counted(docs, longest, least)
    candidates = written(scored(phrases), "candidates")
    best = first_of(whole(candidates, absorbed), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], places)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
  i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) t(k)),
  g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f FROM i GROUP BY ALL),
  n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
  c AS MATERIALIZED (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM g WHERE k > 1 AND f >= {LEAST}),
  t AS (SELECT lang, g, f, w, unnest(range(1, k)) AS j FROM c),
  u AS (SELECT t.lang, t.g, t.f AS a, j, x.f AS l, y.f AS r, (CAST({SCORE} AS HUGEINT) * t.f) // (CAST(x.f AS HUGEINT) + y.f) AS score
    FROM t JOIN g x ON x.lang = t.lang AND x.g = array_to_string(w[1:j], ' ') JOIN g y ON y.lang = t.lang AND y.g = array_to_string(w[j + 1:], ' ')),
  b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
  e AS (SELECT lang, f, w, k, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, {LONGEST}) z(m) WHERE m < k),
  d AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS g, max(f) AS f FROM e GROUP BY ALL)
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank, b.g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
  FROM b JOIN n ON n.lang = b.lang LEFT JOIN d ON d.lang = b.lang AND d.g = b.g WHERE d.f IS NULL OR 100 * CAST(d.f AS HUGEINT) < {ABSORBED} * CAST(a AS HUGEINT) QUALIFY rank <= {PLACES}"""
