"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers are runs of K words. Each gets its occurrence number (how many equal k-mers stand
before it), so repeats stay distinct. A seeded hash of k-mer and number orders them; the LEAST
smallest are dealt by hash into BINS bins; each bin keeps its two smallest, puts them back into text
order and hashes the ordered pair. The fingerprint is the list of these hashes with their bins, so it
changes with the order of words as well as with the words, as edit distance does. Likeness is the
share of equal bins among the bins that either text fills.

Everything happens within the row: arrays of packed longs (40 bits of hash, 24 of position) are
sorted and sliced, without explosion or shuffle. In texts of more than 2^24 words, positions are
counted in steps of two words, four, and so on, as many as make them fit; order within a step goes by hash.

Defined results: null text is empty text, whose fingerprint is empty and like only itself; texts of
one word are one k-mer; equal texts have equal fingerprints; an empty table gives an empty result.
Next documents: rows in descending doc_id (nulls last, ties by text descending); the last row's next
is the first; a single row is its own next.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, table, written

K, BINS, LEAST, SEED = 2, 32, 96, 97
#: Bytes of text in a range bucket, about.
BUCKET_BYTES = 16 << 20
#: Most ranges; beyond, ranges hold more text.
RANGES = 1 << 16

_POSITION = 24
_MASK = (1 << _POSITION) - 1
_NONE = (1 << 63) - 1


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: packed longs in order of their bins, BINS at most (5 bits of bin, 59 of hash).

    Steps are columns of their own, so that each is made once and the sorts run on primitive longs.
    """
    high = lambda x: F.shiftright(x, _POSITION)
    pack = lambda v, p: v.bitwiseAND(F.lit(~_MASK)).bitwiseOR(p.cast("long").bitwiseAND(F.lit(_MASK)))
    w, s, v, d, e, b, y, at = (F.col(f"_{c}") for c in "wsvdebyt")
    none = F.lit(_NONE)
    spaced = F.translate(F.coalesce(F.col(text), F.lit("")), "\n\t\r\x0b\x0c", "     ")
    df = df.withColumn("_w", F.array_remove(F.split(spaced, " "), ""))
    # k-mers, the last word alone if it is the only one, by hash and position
    heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - (K - 1), F.least(F.size(w), F.lit(1))))
    step = F.when(F.size(w) > 1 << _POSITION, F.ceil(F.log2(F.size(w))) - _POSITION).otherwise(0).cast("int")
    kmers = F.transform(heads, lambda x, i: pack(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, K)]), F.call_function("shiftright", i, step)))
    df = df.withColumn("_s", F.sort_array(kmers))
    # first occurrences, with a mark in the place of repeats
    first = F.transform(s, lambda x, i: F.when((i > 0) & (high(F.get(s, i - F.least(i, F.lit(1)))) == high(x)), none).otherwise(pack(F.xxhash64(F.lit(SEED), high(x), F.lit(0)), x)))
    df = df.withColumn("_v", first)
    # repeats: indices, where their runs begin, and so their numbers
    df = df.withColumn("_d", F.when(F.array_contains(v, none), F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i) == none)).otherwise(F.array().cast("array<int>")))
    begin = F.filter(F.sequence(F.lit(0), F.size(d) - 1), lambda j: (j == 0) | (F.get(d, j) != F.get(d, j - F.least(j, F.lit(1))) + 1))
    df = df.withColumn("_e", F.when(F.size(d) > 0, F.concat(begin, F.array(F.size(d)))).otherwise(F.array().cast("array<int>")))
    number = F.flatten(F.transform(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), lambda x, j: F.sequence(F.lit(1), F.get(e, j + 1) - x)))
    more = F.zip_with(d, number, lambda i, o: F.coalesce(pack(F.xxhash64(F.lit(SEED), high(F.get(s, i)), o), F.get(s, i)), none))
    numbered = F.when(F.size(d) > 0, F.concat(v, more)).otherwise(v)
    df = df.withColumn("_b", F.array_remove(F.slice(F.sort_array(numbered), 1, LEAST), none))
    # bins: by bin, then by rank among the least
    bin_of = lambda x: F.pmod(high(x), F.lit(BINS))
    df = df.withColumn("_y", F.sort_array(F.transform(b, lambda x, i: (bin_of(x) * 128 + i).cast("int"))))
    df = df.withColumn("_t", F.when(F.size(y) > 0, F.filter(F.sequence(F.lit(0), F.size(y) - 1), lambda i: (i == 0) | (F.shiftright(F.get(y, i), 7) != F.shiftright(F.get(y, i - F.least(i, F.lit(1))), 7)))).otherwise(F.array().cast("array<int>")))

    def pair(i: Column) -> Column:
        mine, after = F.get(y, i), F.get(y, i + 1)
        one, two = F.get(b, mine.bitwiseAND(F.lit(127))), F.get(b, after.bitwiseAND(F.lit(127)))
        place = lambda x: x.bitwiseAND(F.lit(_MASK))
        alone = after.isNull() | (F.shiftright(after, 7) != F.shiftright(mine, 7))
        h = F.when(alone, F.xxhash64(high(one))).when(place(one) <= place(two), F.xxhash64(high(one), high(two))).otherwise(F.xxhash64(high(two), high(one)))
        return F.shiftleft(F.shiftright(mine, 7).cast("long"), 59).bitwiseOR(F.shiftrightunsigned(h, 5))

    return df.withColumn(out, F.transform(at, pair)).drop(*[f"_{c}" for c in "wsvdebyt"])


def printed(s: Column) -> Column:
    """A signature as text: hexadecimal words joined by commas; empty for an empty signature."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.hex(x))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that either fills; two empty signatures are alike."""
    bins = lambda s: F.transform(s, lambda x: F.shiftrightunsigned(x, 59))
    filled = F.size(F.array_union(bins(a), bins(b)))
    same = F.size(F.array_intersect(a, b))
    return F.when(filled == 0, F.lit(1.0)).otherwise(same / F.greatest(filled, F.lit(1))).cast("double")


def with_next(docs: DataFrame, columns: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Adds ``next_<column>`` of the next row in descending doc_id; ``prepare`` adds columns to each row before.

    Ids are cut into ranges of about equal text, in two steps of equally many parts: the driver gets the
    cuts of the first step only (255 at most), the others stay a table. A row's next lies in its own range,
    or is the first row of the next lower range, of which each range gets a copy. Both tables that are
    broadcast have a row per range at most, and there are RANGES at most.
    """
    spark = docs.sparkSession
    stats = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, min(int(stats["n"]), RANGES, max(spark.sparkContext.defaultParallelism, -(-(stats["b"] or 0) // BUCKET_BYTES))))
    side = max(2, math.isqrt(n - 1) + 1)
    shares = F.array(*[F.lit(i / side) for i in range(1, side)])
    known = docs.where(F.col("doc_id").isNotNull())
    cuts = known.agg(F.percentile_approx("doc_id", shares, F.lit(100_000)).alias("c")).first()["c"]
    major = _position(F.col("doc_id"), sorted(set(cuts or [])))
    finer = written(known.groupBy(major.alias("major")).agg(F.array_distinct(F.percentile_approx("doc_id", shares, F.lit(10_000))).alias("cuts")), "cuts")
    # null ids come last: below every cut
    minor = F.size(F.filter("cuts", lambda c: c <= F.col("doc_id")))
    at = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("major") * side + minor).cast("int")
    d = docs.withColumn("major", F.when(F.col("doc_id").isNotNull(), major)).join(F.broadcast(finer), "major", "left")
    d = d.withColumn("range", at).drop("major", "cuts")
    heads = d.groupBy("range").agg(F.max("doc_id").alias("top"))
    # RANGES rows at most: the range above each, and the lowest above the top one
    above = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy()))
    heads = written(heads.withColumn("above", above), "heads")
    firsts = d.join(F.broadcast(heads), "range").where(F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = firsts.groupBy("above", "doc_id").agg(F.max("text").alias("text")).withColumnRenamed("above", "range")
    both = d.withColumn("guest", F.lit(0)).unionByName(firsts.withColumn("guest", F.lit(1)), allowMissingColumns=True)
    row = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    out = prepare(both).withColumns({f"next_{c}": F.lead(c).over(row) for c in columns})
    return out.where("guest = 0").drop("guest", "range")


def _position(x: Column, cuts: list[int]) -> Column:
    """How many cuts are at most ``x``, by a balanced tree of comparisons."""
    if not cuts:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def fingerprints(docs: DataFrame) -> DataFrame:
    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d, ["text", "sig"], lambda r: with_signature(r, "text", "sig")).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    d = with_signature(d, "edited", "edited_sig")
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sig")).alias("fingerprint"), printed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
