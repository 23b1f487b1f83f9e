import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.golden import library
from vistaset import catalog
from vistaset.errors import QueryError
from vistaset.operators import cluster, etl, pixels
from vistaset.operators.expand import padded
from vistaset.session import Session
from vistaset.sources import exif
from vistaset.sources import library as sources
from vistaset.sources.library import Library, Pack
from vistaset.streaming import refresh


@pytest.fixture(scope="module")
def lib(spark):
    return library(spark)


def test_is_a(lib):
    assert lib.is_a("apple", "food") and lib.is_a("apple", "root") and not lib.is_a("cat", "food")
    assert set(lib.descendants("food")) == {"apple", "banana", "fruit"}
    loop = Library(lib.images, lib.collections, (("a", "b"), ("b", "a")))
    assert not loop.is_a("a", "c")


def test_index_reader(spark, tmp_path):
    doc = {"version": "1.2", "entries": {"a.jpg": {"mtime": 3, "objects": [{"class": "cat", "confidence": 0.5}]}}, "collections": {"c": ["a.jpg", "b.jpg"]}}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    images, albums = sources.read_index(spark, str(tmp_path / "i.json"))
    r = images.first()
    assert r["img_attrs"]["exposure_goodness"] == 1 and r["img_attrs"]["iso"] == -1 and len(r["img_attrs"]["scene_vector"]) == 365
    assert r["objects"][0]["parent_id"] == -1 and r["size"] == 0 and albums.count() == 2
    (tmp_path / "o.json").write_text(json.dumps(doc | {"version": "0"}))
    with pytest.raises(QueryError):
        sources.read_index(spark, str(tmp_path / "o.json"))
    (tmp_path / "l.json").write_text(json.dumps({"images": [{"path": "x"}, {"path": "y"}]}))
    assert {(r["path"], r["img_id"]) for r in sources.read_legacy(spark, str(tmp_path / "l.json")).collect()} == {("x", 0), ("y", 1)}


def test_vocabulary_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"classes": [{"name": "cat", "parent": "animal"}, {"name": "dog"}]}))
    assert sources.read_classes(spark, str(tmp_path / "c.json")) == (("cat", "animal"), ("dog", "root"))
    (tmp_path / "l.txt").write_text("/b/beach 48\n/f/forest/broadleaf 150\nplain 3\n")
    assert sources.read_labels(spark, str(tmp_path / "l.txt")) == ("beach", "broadleaf", "plain")
    assert sources.read_settings("[inference]\nbase_conf = 0.5\n") == {"fallback_threshold": 0.0, "base_conf": 0.5, "iou_threshold": 0.45}


def test_directory_and_snapshots(spark, tmp_path, lib):
    for n in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"xyz")
    got = sources.scan_directory(spark, [str(tmp_path)]).collect()
    assert [(r["path"], r["size"]) for r in got] == [("a.png", 3), ("b.JPG", 3)]
    assert sources.count_pictures(spark, str(tmp_path)).first()[0] == 2
    folder = str(tmp_path / "snap")
    sources.write_snapshot(lib.images, folder, "m")
    sources.write_snapshot(lib.images.limit(2), folder, "m")
    assert sources.read_snapshot(spark, folder, "m").count() == 2


def test_exif():
    text = b"Acme\0"
    tiff = bytearray(64)
    tiff[:10] = b"II*\0" + struct.pack("<IH", 8, 2)
    struct.pack_into("<HHII", tiff, 10, 0x010F, 2, 5, 48)
    struct.pack_into("<HHII", tiff, 22, 0x8827, 3, 1, 400)
    tiff[48:53] = text
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + bytes(tiff) + b"\xff\xd9"
    assert exif.read(data) == {"camera_make": "Acme", "iso": 400}
    assert exif.read(b"") == {} and exif.read(data[:40]) == {}


def test_pixels():
    red = np.zeros((8, 8, 3), np.uint8)
    red[..., 2] = 255
    a = pixels.image_attrs(red)
    assert a["dominant_color"] == "red" and a["global_hue_hist"][0] == 1 and a["avg_saturation"] == 1 and a["global_blur_score"] == 0
    assert 2000 <= a["color_temperature"] <= 10000 and pixels.temperature(np.zeros(3)) == 0
    white = np.full((4, 4, 3), 255, np.uint8)
    assert pixels.image_attrs(white)["overexposure_score"] == 1 and pixels.image_attrs(white)["dominant_color"] == "white"
    assert pixels.object_attr(red, (0.5, 0.5, 0.5, 0.5))["lbp"] == 0 and pixels.object_attr(red, (3, 3, 0.1, 0.1)) == {}
    noise = np.random.default_rng(0).integers(0, 256, (32, 32, 3), dtype=np.uint8)
    assert pixels.image_attrs(noise)["global_blur_score"] > 0.5


def test_detections():
    box, scale, left, top = pixels.letterbox(np.zeros((50, 100, 3), np.uint8), 64)
    assert box.shape == (3, 64, 64) and scale == 0.64 and (left, top) == (0, 16)
    raw = np.zeros((6, 2), np.float32)
    raw[:, 0] = [32, 32, 32, 16, 0.9, 0.1]
    ((k, c, x, y, w, h),) = pixels.decode(raw, 0.25, scale, left, top, 100, 50)
    assert (k, round(c, 3)) == (0, 0.9) and (x, y, w, h) == pytest.approx((0.5, 0.5, 0.5, 0.5))
    boxes = [(0, 0.9, 0.5, 0.5, 0.4, 0.4), (0, 0.99, 0.5, 0.5, 0.36, 0.36), (1, 0.5, 0.5, 0.5, 0.36, 0.36), (0, 0.5, 0.1, 0.1, 0.1, 0.1)]
    assert pixels.suppress(boxes, 0.45) == [boxes[0], boxes[2], boxes[3]] and pixels.suppress([], 0.5) == []


def test_refresh(spark, lib):
    listing = spark.createDataFrame([("a.jpg", 0, 0), ("b.jpg", 5, 0), ("e.jpg", 1, 9)], "path string, mtime bigint, size bigint")
    made = []

    def build(rows):
        made.append(sorted(r["path"] for r in rows.collect()))
        old = lib.images.limit(1).drop("path", "mtime", "size")
        return rows.crossJoin(old).select(*lib.images.columns)

    tagged = lib.with_images(catalog.set_tag(lib.images, None, "k", "v"))
    out = etl.refresh(tagged, listing, build)
    got = {r["path"]: (r["img_id"], r["img_attrs"]["user_tags"].get("k")) for r in out.images.collect()}
    assert made == [["b.jpg", "e.jpg"]] and got.keys() == {"a.jpg", "b.jpg", "e.jpg"}
    assert got["b.jpg"] == (1, "v") and got["e.jpg"][0] == 4


def test_expand(spark, lib):
    packs = {"parts": Pack("parts", "animal", ("ear", "tail"), conf_threshold=0.5), "off": Pack("off", active=False), "emb": Pack("emb", can_cluster=True), "lost": Pack("lost", "ghost")}
    s = Session(Library(lib.images, lib.collections, lib.classes, lib.labels, packs), predictors={"parts": lambda f: [[(0, 0.9, 0.0, 0.0, 0.5, 0.5), (1, 0.4, 0, 0, 1, 1)]] * len(f)})
    rows = s.run("(% $) >> parts").objects().collect()
    assert {(r["image_path"], r["o"]["class"], r["o"]["super_class"]) for r in rows} == {("a.jpg", "ear", "cat"), ("a.jpg", "ear", "dog")}
    x1, y1, x2, y2 = padded(0.2, 0.5, 0.2, 0.3, 0.1)
    cat = next(r for r in rows if r["o"]["super_class"] == "cat")
    assert cat["o"]["x"] == pytest.approx(x1 + 0.25 * (x2 - x1)) and cat["o"]["w"] == pytest.approx(0.5 * (x2 - x1))
    assert cat["score"] == pytest.approx(0.81) and cat["o"]["parent_id"] == 0
    assert s.run("(% $) >> emb").objects().count() == 6
    for name in ("off", "lost", "none"):
        with pytest.raises(QueryError):
            s.run(f"(% $) >> {name}")


def test_clusters(spark):
    v = {1: [1.0, 0.0], 2: [0.8, 0.6], 3: [0.28, 0.96], 4: [-1.0, 0.0]}
    items = spark.createDataFrame(list(v.items()), "id bigint, vec array<float>")
    assert {(r["a"], r["b"]) for r in cluster.similar(items, 0.79).collect()} == {(1, 2), (2, 3)}
    assert {r["id"]: r["comp"] for r in cluster.groups(items, 0.79).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r["id"]: r["comp"] for r in cluster.density(items, 0.79, 3).collect()} == {1: 2, 2: 2, 3: 2, 4: None}
    members = spark.createDataFrame([("b", 1, 7), ("a", 2, 9), ("c", 3, 7)], "path string, obj_id bigint, comp bigint")
    assert {r["obj_id"]: r["cluster_id"] for r in cluster.numbered(members, "face", "person").collect()} == {1: "face_person_002", 2: "face_person_001", 3: "face_person_002"}


def test_albums_and_names(spark, lib):
    c = catalog.add_to_album(lib.collections, " trip ", spark.createDataFrame([("a.jpg",), ("d.jpg",)], "path string"))
    assert [(r["pos"], r["path"]) for r in c.where("name = 'trip'").orderBy("pos").collect()] == [(0, "a.jpg"), (1, "gone.jpg"), (2, "d.jpg")]
    assert catalog.remove_from_album(c, "trip", spark.createDataFrame([("d.jpg",)], "path string")).count() == 2
    assert catalog.rename_album(c, "trip", "tour").where("name = 'tour'").count() == 3 and catalog.remove_album(c, "trip").count() == 0
    names = catalog.new_names(lib.images, "{object}?{index}")
    assert {r["old"]: r["new"] for r in names.collect()} == {"a.jpg": "cat1.jpg", "b.jpg": "apple2.jpg", "c.jpg": "unknown3.jpg", "d.jpg": "person4.jpg"}
    assert sorted(r["conflict"] for r in catalog.new_names(lib.images, "same").collect()) == [False, True, True, True]
    out, smart = catalog.rename(lib, names, {"mine": 'collection("a.jpg")'})
    swap = spark.createDataFrame([("a.jpg", "b.jpg"), ("b.jpg", "c.jpg")], "old string, new string")
    assert catalog.rename(lib, swap, {"two": '"a.jpg" "b.jpg"'})[1] == {"two": '"b.jpg" "c.jpg"'}
    assert smart == {"mine": 'collection("cat1.jpg")'} and out.collections.where("path = 'cat1.jpg'").count() == 1


def test_tags_and_reports(spark, lib):
    one = spark.createDataFrame([("a.jpg",)], "path string")
    tags = lambda df: {r["path"]: r["t"] for r in df.select("path", F.col("img_attrs.user_tags").alias("t")).collect()}
    assert tags(catalog.rate(lib.images, one, 5))["a.jpg"] == {"place": "home", catalog.RATING: "5"}
    assert tags(catalog.remove_tag(lib.images, one, "place"))["a.jpg"] == {}
    assert tags(catalog.replace_tags(lib.images, one, {"x": "y"})) == {"a.jpg": {"x": "y"}, "b.jpg": {}, "c.jpg": {}, "d.jpg": {}}
    with pytest.raises(QueryError):
        catalog.rate(lib.images, one, 6)
    page = catalog.report_html(catalog.report(lib, Session(lib).run("$ any cat").table()))
    assert "a.jpg 0.900" in page and "cat (90%), dog (80%)" in page


def test_stream(spark, tmp_path):
    schema = "id bigint, ts bigint, v string, gone boolean"
    state = {}

    def save(df, number):
        state["rows"] = [tuple(r) for r in df.collect()]

    def load():
        return spark.createDataFrame(state["rows"], schema) if "rows" in state else None

    for rows in ([(1, 1, "a", False), (2, 1, "b", False)], [(1, 3, "c", False), (1, 2, "x", False), (2, 2, "b", True)], [(2, 1, "late", False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        refresh.follow(stream, load, save, "id", ["ts"], "gone", str(tmp_path / "cp")).awaitTermination(120)
    # the tombstone of 2 keeps a late older row away
    assert sorted(state["rows"]) == [(1, 3, "c", False), (2, 2, "b", True)]
    assert [tuple(r) for r in refresh.live(load(), "gone").collect()] == [(1, 3, "c")]


def test_object_ids_and_completion(spark, lib):
    i = lib.images.withColumn("objects", F.transform("objects", lambda o: o.withField("obj_id", F.lit(-1).cast("bigint"))))
    rows = etl.with_object_ids(i, 100).orderBy("path").collect()
    assert [o["obj_id"] for r in rows for o in r["objects"]] == list(range(100, 100 + sum(len(r["objects"]) for r in rows)))
    assert all(o["img_id"] == r["img_id"] for r in rows for o in r["objects"])
    assert etl.with_object_ids(i.limit(0), 0).count() == 0
    done = etl.completed(lib.images, lib, 2.0).collect()
    assert all(o["is_fallback"] for r in done for o in r["objects"] if o["super_class"] not in ("", "root"))


def test_built_images_get_new_object_ids(spark, lib):
    listing = lib.images.select("path", (F.col("mtime") + 1).alias("mtime"), "size")
    before = etl.next_ids(lib.images).first()["next_obj_id"]
    out = etl.refresh(lib, listing, lambda w: w.select("path", "mtime", "size").join(lib.images.drop("mtime", "size"), "path"))
    ids = [o["obj_id"] for r in out.images.collect() for o in r["objects"]]
    assert len(ids) == len(set(ids)) and min(ids) >= before


def test_picture_endings_in_any_case(spark, tmp_path):
    for n in ("b.jPG", "a.PnG", "c.txt", "d.JPg"):
        (tmp_path / n).write_bytes(b"xyz")
    assert [r["path"] for r in sources.scan_directory(spark, [str(tmp_path)]).collect()] == ["a.PnG", "b.jPG", "d.JPg"]
