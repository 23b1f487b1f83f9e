"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

The corpus total is shared among sources by weight with targets capped at three times the source
(water-filling in closed form over the sorted cap-to-weight ratios). Sainte-Lague quotients give each
source its integer number of tokens, and again each (source, shard) cell its part, a cell being the
source's rows in one hash shard; a source has as many shards as its rows need. A cell's part never passes
``most`` times the cell, as its source's does not. Within a cell the documents lie in a seeded order end
to end, cut into blocks of equal tokens; whole passes over the cell come first and the rest are blocks
with the lowest seeded hashes, the last of them taken in part. All of it is DataFrame functions; every window is over the rows
of a cell, over the sources, or over a source's cells.

Defined results: null text has size 0 and takes nothing; null source is a source of its own, last;
an empty table gives an empty result; identical rows share a cell and are told apart by position;
very long texts span several blocks; equal quotients go to the first source by code point, or cell by number;
extra columns are carried by ``taken_documents``, whatever their names; sources without words have target 0.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, own_columns, table, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
#: Rows of a source's hash shard, about; tokens of a block.
SHARD_ROWS, BLOCK_TOKENS = 2048, 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight, capped at ``most`` times the source.

    Sources are sorted by cap / weight; the capped ones form a prefix, and the rest share what it
    leaves. The level of the first source that is not above its cap is the level of all that follow.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights)).cast("int") + 1).cast("double")
    s = sources.withColumn("at", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.orderBy(F.desc("ratio"), F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open_w", F.sum("w").over(here))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w"))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "at", "level"))
    s = s.withColumn("level", F.min(fits).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.col("level"))
    return s.select("source", "source_size", "total", F.coalesce(target, F.lit(0.0)).alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: Column, group: list[str], tie: list[str], out: str) -> DataFrame:
    """Adds ``out``: the seats of each party when ``seats`` of a group go to the highest quotients.

    The k-th seat of a party with share q is won at (k - 1/2) / q. With n parties and M seats the last
    seat is won between 1 - n/2M and 1 + n/2M, so seats below that window are certain and only those
    inside it, about four per party, are ranked.
    """
    # floating-point slack of one seat on either side keeps the window safe
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    p = parties.withColumn("_seats", seats).withColumn("_n", F.count(F.lit(1)).over(own)).withColumn("_votes", F.sum(votes).over(own))
    p = p.withColumn("_q", F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes") * F.col("_seats")).otherwise(0.0))
    slack = F.col("_n") / (2.0 * F.greatest(F.col("_seats"), F.lit(1)))
    p = p.withColumn("_low", F.greatest(F.floor(F.col("_q") * (1 - slack) - 0.5), F.lit(0)))
    p = p.withColumn("_high", F.ceil(F.col("_q") * (1 + slack) + 0.5))
    p = p.withColumn("_rest", F.col("_seats") - F.sum("_low").over(own))
    open_ = p.where((F.col("_q") > 0) & (F.col("_high") > F.col("_low"))).select(
        *group, *[t for t in tie if t not in group], "_rest", F.col(votes).cast("double").alias("_v"),
        F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"),
    )
    ranked = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ranked = ranked.orderBy(F.desc(F.col("_v") / (2 * F.col("_k") - 1)), *[F.col(t).asc_nulls_last() for t in tie], "_k")
    won = open_.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= F.col("_rest"))
    keys = list(dict.fromkeys([*group, *tie]))
    won = won.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    joined = p.alias("p").join(won.alias("v"), functools.reduce(Column.__and__, [F.col(f"p.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys]), "left")
    return joined.select(*[F.col(f"p.{c}") for c in parties.columns], (F.col("_low") + F.coalesce(F.col("_won"), F.lit(0))).alias(out))


def mix(docs: DataFrame, n_rows: int, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, size and any payload): source_size, target, taken, passes, parts.

    ``passes`` counts whole copies; ``parts`` are the [start, end) word ranges, from 0, taken once more.
    ``n_rows`` tells only whether a source may need more than one shard.
    """
    payload = [c for c in docs.columns if c not in ("source", "size")]
    d = docs.withColumn("_shards", F.lit(1).cast("long"))
    if n_rows > SHARD_ROWS:
        # at most n_rows / SHARD_ROWS sources are that large
        large = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > SHARD_ROWS)
        large = large.select("source", F.ceil(F.col("_rows") / SHARD_ROWS).alias("_shards"))
        d = docs.alias("d").join(F.broadcast(large.alias("l")), F.col("d.source").eqNullSafe(F.col("l.source")), "left").select("d.*", F.coalesce("_shards", F.lit(1)).alias("_shards"))
    d = d.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("_shards"))).drop("_shards")
    cells = d.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    sources = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    goal = targets(sources, weights, most)
    goal = goal.withColumn("block", F.lit(BLOCK_TOKENS).cast("long"))
    goal = sainte_lague(goal, "target", F.col("total"), [], ["source"], "quota")
    goal = goal.withColumn("quota", F.least(F.col("quota"), most * F.col("source_size")))
    c = cells.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select(
        "c.source", "shard", "cell_size", "source_size", "target", "block", "quota"
    )
    c = sainte_lague(c, "cell_size", F.col("quota"), ["source"], ["shard"], "need")
    c = c.withColumn("passes", F.when(F.col("cell_size") > 0, F.floor(F.col("need") / F.greatest(F.col("cell_size"), F.lit(1)))).otherwise(0))
    c = c.withColumn("n_blocks", F.ceil(F.col("cell_size") / F.col("block")))
    c = c.withColumn("extra", F.col("need") - F.col("passes") * F.col("cell_size"))
    blocks = c.where(F.col("extra") > 0).select(
        "source", "shard", "block", "cell_size", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("at")
    )
    lot = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "source", "shard", "at"), "at")
    length = F.least(F.col("block"), F.col("cell_size") - F.col("at") * F.col("block"))
    chosen = blocks.withColumn("length", length).withColumn("before", F.sum("length").over(lot.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    chosen = chosen.where(F.col("before") < F.col("extra")).select("source", "shard", "at", F.least("length", F.col("extra") - F.col("before")).alias("some"))

    row = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id", "size"), "size", *payload)
    slim = d.withColumn("row", F.row_number().over(row))
    slim = slim.withColumn("end", F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    slim = slim.withColumn("start", F.col("end") - F.col("size"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.shard") == F.col(f"{b}.shard"))
    slim = slim.alias("d").join(c.alias("c"), same("d", "c")).select("d.*", "source_size", "target", "block", "passes", "extra")
    touched = slim.where((F.col("extra") > 0) & (F.col("size") > 0)).select(
        "source", "shard", "row", "start", "end", "block",
        F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block")))).alias("at"),
    )
    hit = touched.alias("t").join(chosen.alias("b"), same("t", "b") & (F.col("t.at") == F.col("b.at"))).select(
        "t.source", "t.shard", "row",
        (F.greatest(F.col("start"), F.col("t.at") * F.col("block")) - F.col("start")).alias("from"),
        (F.least(F.col("end"), F.col("t.at") * F.col("block") + F.col("some")) - F.col("start")).alias("to"),
    ).where(F.col("from") < F.col("to"))
    parts = hit.groupBy("source", "shard", "row").agg(F.sum(F.col("to") - F.col("from")).alias("part"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("parts"))
    out = slim.alias("d").join(parts.alias("p"), same("d", "p") & (F.col("d.row") == F.col("p.row")), "left")
    taken = F.col("size") * F.col("passes") + F.coalesce(F.col("part"), F.lit(0))
    return out.select(*[f"d.{p}" for p in payload], "d.source", "size", "source_size", "target", taken.cast("long").alias("taken"), "passes", "parts")


def taken_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix as documents: whole copies, and one row of the words that blocks take once more.

    All columns of ``docs`` stay; ``text`` and ``n_chars`` follow what is taken, white space included.
    """
    names, at = docs.columns, {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.col(at["text"])
    # rows get numbers that stay: equal rows are rows of their own
    rows = written(docs.toDF(*at.values()).withColumn("row_id", F.monotonically_increasing_id()), "rows")
    sized = rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), "row_id", size_of(text).alias("size"))
    got = mix(sized, rows.count(), weights, most, seed).where(F.col("taken") > 0)
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    d = rows.join(got.select("row_id", F.col("passes").cast("int").alias("passes"), F.coalesce("parts", none).alias("parts")), "row_id")
    blank = "[\\x20\\x09-\\x0D]"
    words = F.split(F.regexp_replace(text, f"^{blank}+", ""), f"(?<={blank})(?!{blank})")
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), "")
    texts = F.concat(F.array_repeat(text, F.col("passes")), F.when(F.size("parts") > 0, F.array(F.regexp_replace(cut, f"{blank}+$", ""))).otherwise(F.array().cast("array<string>")))
    out = d.withColumn("taken_text", F.explode(texts))
    new = {"text": F.col("taken_text"), "n_chars": F.length("taken_text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*[new.get(c, F.col(at[c])).alias(at[c]) for c in names]).toDF(*names)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_columns(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    sized = docs.select(F.col("doc_id").cast("long"), "source", size_of(F.col("text")).alias("size"))
    return mix(sized, docs.count()).select("doc_id", "size", "source_size", "target", "taken", "source")
