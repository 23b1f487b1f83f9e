"""The library made of the star-schema tables."""

import re

import pytest
from pyspark.sql import functions as F

from vistaset import catalog
from vistaset.operators import cluster, sets
from vistaset.session import Session
from vistaset.sources import derived

ITEMS = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate date"


@pytest.fixture
def tables(spark, tmp_path):
    items = [(1, 2, 40, 3, 5.0, 1.0, 0.02, 0.0, None), (1, 1, 99, 3, 5.0, 1.0, 0.02, 0.0, None), (1, 2, 40, 3, 5.0, 0.5, 0.04, 0.0, None), (2, 1, 35, 7, 50.0, 1.0, 0.0, 0.0, None)]
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(40, "PROMO"), (35, "SMALL")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    orders = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"
    spark.createDataFrame([(k, 1, "F", "5-LOW", None) for k in (1, 2, 3)], orders).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_places_are_those_of_the_join(spark, tables):
    """An item without a part takes no place; items alike in line, part, supplier and quantity go by price."""
    got = {r["path"]: [(o["obj_id"], o["class"], round(o["confidence"], 6)) for o in r["objects"]] for r in derived.library(spark, tables).images.collect()}
    assert got == {"img_00000001.jpg": [(1001, "promo", 0.8), (1002, "promo", 0.9)], "img_00000002.jpg": [(2001, "small", 1.0)], "img_00000003.jpg": []}


def test_objects_are_made_where_they_are_read(spark, tables):
    """What is shuffled and listed are columns of line items; objects are made once for a filter and its score."""
    assert [f.name for f in derived.items(spark, tables).schema["l"].dataType.elementType] == [*derived.ITEM, "class"]
    plan = Session(derived.library(spark, tables)).run("$ any promo").table()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(l") == 1


@pytest.mark.parametrize("key", [-40, -1, 0, 16, 17, 12345])
def test_histograms_by_key(spark, key):
    got = spark.range(1).select(derived._hist(derived.F.lit(key), 32, 200).alias("h")).first()["h"]
    rest = lambda v: abs(v) % 17 * (1 if v >= 0 else -1)
    assert got == pytest.approx([rest(key + i * i) / 200 for i in range(32)])


def test_similarity_is_made_once(spark, tables):
    """A step that reads its score several times, and a filter beside its column, do not repeat it."""
    got = Session(derived.library(spark, tables)).run("$ : (any(hist_sim(obj_hist(obj), img_hist())))").table()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("zip_with(") == 1
    bins = lambda k: [(k + i * i) % 17 for i in range(32)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    like = lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5
    assert {r["path"]: r["score"] for r in got.collect()} == pytest.approx({"img_00000001.jpg": like(bins(1), bins(40)), "img_00000002.jpg": like(bins(2), bins(35))}, rel=1e-6)


def test_many_items_are_dealt_to_more_tasks(spark, tables, monkeypatch):
    """Beyond what a task shall hold, items, parts and bags of objects go to more tasks than the session's; rows stay the same."""
    script = "(% ($ any promo)) - (% ($ any small))"
    few = derived.library(spark, tables)
    want = [r["objects"] for r in few.images.orderBy("path").collect()], Session(few).run(script).objects().count()
    monkeypatch.setattr(derived, "ITEMS", 1)
    monkeypatch.setattr(derived, "PARTS", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        many = derived.library(spark, tables)
        bag = Session(many).run(script).objects()
        plan = bag._jdf.queryExecution().executedPlan().toString()
        got = [r["objects"] for r in many.images.orderBy("path").collect()], bag.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (few.tasks, many.tasks) == (0, 4) and got == want
    for key in ("l_orderkey", "o_orderkey", "l_partkey", "_key"):
        assert re.search(rf"hashpartitioning\({key}#\d+L?, 4\)", plan)


def test_cards_of_kept_rows_are_not_looked_up(spark, tables):
    """Results with their images' columns meet no library; others meet texts, not histograms."""
    lib = derived.library(spark, tables)
    found = Session(lib).run("$ any promo")
    own, met = catalog.report(lib, found.rows()), catalog.report(lib, found.table())
    assert own.collect() == met.collect() and own.count() == 1
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (path" not in plan(own) and "scene_vector" not in plan(met).split("Join Inner, (path")[0]


def test_stored_vectors_are_clustered_without_objects(spark, tables):
    """Where vectors are stored, clusters and their counts read no objects."""
    images = derived.library(spark, tables).images.withColumn("objects", F.when(F.raise_error(F.lit("read")).isNull(), F.col("objects")))
    items = spark.createDataFrame([("img_00000001.jpg", 1001, [1.0, 0.0]), ("img_00000001.jpg", 1002, [0.0, 1.0]), ("img_00000002.jpg", 2001, [1.0, 0.0])], "path string, obj_id long, vec array<float>")
    counts = cluster.cluster_counts(cluster.cluster_images(images, "look", "look", 0.9, "promo", items), "look")
    assert [tuple(r) for r in counts.collect()] == [("look_promo_001", 2), ("look_promo_002", 1)]


def test_tasks_are_bounded_though_partitions_are_put_together(spark, tables, monkeypatch):
    """A session's partitions do not keep tasks small: adaptive execution leaves as many as there are cores."""
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert derived.library(spark, tables).tasks == 0
        monkeypatch.setattr(derived, "ITEMS", 1)
        assert derived.tasks(spark.range(spark.sparkContext.defaultParallelism + 1)) == spark.sparkContext.defaultParallelism + 1
        assert derived.tasks(spark.range(spark.sparkContext.defaultParallelism)) == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("script", ["($ any promo) | ($ any small)", "($ any promo) & ($ : (any(promo)))", "$ - ($ any promo) - ($ any small)"])
def test_image_sets_are_dealt_to_the_library_s_tasks(spark, tables, monkeypatch, script):
    """Both sides go to at least as many tasks, once each; rows stay the same."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(map(tuple, Session(derived.library(spark, tables)).run(script).table().collect()))
        monkeypatch.setattr(derived, "tasks", lambda df: 7)
        got = Session(derived.library(spark, tables)).run(script).table()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == want and want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\(path#\d+, (\d+)\)", plan)
    assert dealt == ["7"] * {"|": 1, "&": 2, "-": 3}[next(c for c in "|&-" if c in script)]


def test_places_are_given_in_as_many_ranges(spark, monkeypatch):
    df = spark.range(20).select(F.col("id").alias("path"), (F.col("id") % 3).alias("score"))
    seen = []
    monkeypatch.setattr(sets, "written", lambda d, name: seen.append(d._jdf.queryExecution().executedPlan().toString()) or d.localCheckpoint())
    rows = sets.numbered(df, F.asc("score"), F.asc("path"), tasks=6).orderBy("place").collect()
    assert "rangepartitioning" in seen[0] and ", 6), REPARTITION_BY_NUM" in seen[0]
    assert [(r["score"], r["path"], r["place"]) for r in rows] == [(s, p, i + 1) for i, (s, p) in enumerate(sorted((k % 3, k) for k in range(20)))]


@pytest.mark.parametrize("op", "&-|")
def test_bags_move_once(spark, tables, monkeypatch, op):
    """Each side of an operation on bags of objects moves by its keys once, whatever tasks the library names."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(derived, "tasks", lambda df: 7)
    try:
        bag = Session(derived.library(spark, tables)).run(f"(% ($ any promo)) {op} (% ($ any promo))").objects()
        plan = bag._jdf.queryExecution().executedPlan().toString()
        assert bag.count() == {"&": 2, "-": 0, "|": 2}[op]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.findall(r"Exchange hashpartitioning\(_key#\d+, (\d+)\)", plan) == ["7", "7"]
