"""Similarity joins by pivots, versions, pictures, and libraries that follow streams."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.golden import library
from vistaset.errors import QueryError
from vistaset.operators import cluster, detect, embed, etl, pixels, runs
from vistaset.sources import pictures, versions
from vistaset.sources.library import Library, Pack
from vistaset.streaming import folder, keyed


def _clusters(n, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 16))
    x = centre[rng.integers(0, 12, n)] + rng.normal(0, spread * 4, (n, 16))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _items(spark, x):
    return spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<float>").repartition(3)


def _brute(x, t):
    s = x @ x.T
    return {(i * 3, j * 3) for i, j in zip(*np.nonzero(np.triu(s >= np.float32(t), 1)), strict=True)}


def _groups(n, pairs):
    top = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            top[a // 3] = top[b // 3] = min(top[a // 3], top[b // 3])
    return {i * 3: top[i] * 3 for i in range(n)}


@pytest.mark.parametrize(("block", "threshold", "scale"), [(2048, 0.9, 1), (37, 0.9, 1), (37, 0.2, 1), (64, -0.5, 1), (64, 0.7, 3)])
def test_similar_by_pivots(spark, monkeypatch, block, threshold, scale):
    """Clusters, a third of all vectors equal, vectors of unequal length, thresholds below zero."""
    monkeypatch.setattr(cluster, "BLOCK", block)
    x = _clusters(400, 1)
    x[::3] = x[0]
    if scale > 1:
        x *= np.random.default_rng(2).uniform(0.2, scale, (len(x), 1)).astype(np.float32)
    got = [(r["a"], r["b"]) for r in cluster.similar(_items(spark, x), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(x, threshold)
    assert {r["id"]: r["comp"] for r in cluster.groups(_items(spark, x), threshold).collect()} == _groups(len(x), sorted(_brute(x, threshold)))


def test_pivots_compare_few_pairs(spark):
    n = 6000
    c = cluster.cells(_items(spark, _clusters(n, 3)), 0.9)
    assert c.compared < n * (n - 1) / 2 / 8


def test_null_vectors_and_no_vectors(spark):
    items = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id bigint, vec array<float>")
    assert [tuple(r)[:2] for r in cluster.similar(items, 0.5).collect()] == [(2, 3)]
    assert {tuple(r) for r in cluster.groups(items, 0.5).collect()} == {(1, 1), (2, 2), (3, 2)}
    assert cluster.groups(items.limit(0), 0.5).count() == 0


def test_forest():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 60, 200), rng.integers(0, 60, 200)
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    at = cluster.forest(a, b)
    group = lambda e: _groups(60, [(p * 3, q * 3) for p, q in e])
    assert group(zip(a, b, strict=True)) == group(zip(a[at], b[at], strict=True))
    assert len(at) == len(np.unique(np.concatenate([a, b]))) - len({group(zip(a, b, strict=True))[i * 3] for i in np.unique(np.concatenate([a, b]))})


def test_versions(spark, tmp_path):
    i, at = library(spark).images, str(tmp_path / "lib")
    sizes = lambda n=None: {r["path"]: r["size"] for r in versions.read(spark, at, "m", n).collect()}
    with pytest.raises(QueryError):
        versions.read(spark, at, "m")
    versions.replace(i, at, "m", "one")
    open_ = versions.read(spark, at, "m")
    versions.change(i.where("path = 'a.jpg'").withColumn("size", F.lit(7).cast("long")), i.where("path in ('a.jpg', 'b.jpg')"), at, "m", batch=4)
    assert sizes() == {"a.jpg": 7, "c.jpg": 0, "d.jpg": 0} and open_.count() == 4 and len(sizes(0)) == 4
    # a repeated batch changes nothing; a draft that a crash left is no version
    assert versions.change(i.limit(0), i, at, "m", batch=4).number == 1 and versions.numbers(spark, at, "m") == [0, 1]
    (tmp_path / "lib" / "versions" / "m" / ".draft").write_text("{")
    assert len(sizes()) == 3
    with pytest.raises(QueryError):
        versions._publish(spark, at, "m", versions.Version(1, ()))
    for k in range(versions.CHANGES):
        versions.change(i.where("path = 'b.jpg'").withColumn("size", F.lit(k).cast("long")), None, at, "m", batch=5 + k)
    assert len(versions.version(spark, at, "m").tables) == 1 and sizes() == {"a.jpg": 7, "b.jpg": versions.CHANGES - 1, "c.jpg": 0, "d.jpg": 0}
    assert versions.expire(spark, at, "m", 1) == versions.CHANGES + 1 and len(sizes()) == 4


def png(pixels: np.ndarray) -> bytes:
    """A PNG of rows of grey, RGB or RGBA pixels."""
    h, w, n = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in pixels))) + chunk(b"IEND", b"")


def _picture(seed, n=3):
    return np.random.default_rng(seed).integers(0, 256, (6, 9, n), dtype=np.uint8)


def test_pictures_are_decoded(spark, tmp_path):
    for n in (1, 3, 4):
        p = _picture(n, n)
        if n == 4:
            p[..., 3] = 255
        (tmp_path / f"{n}.png").write_bytes(png(p))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    rows = pictures.read_pictures(spark, str(tmp_path))
    got = {r["path"]: r for r in rows.collect()}
    assert got["bad.png"]["data"] is None and [r["path"] for r in pictures.undecodable(rows).collect()] == ["bad.png"]
    for n in (1, 3, 4):
        r, p = got[f"{n}.png"], _picture(n, n)
        want = np.repeat(p, 3, 2) if n == 1 else p[..., :3][..., ::-1]
        assert (r["height"], r["width"]) == (6, 9) and np.array_equal(np.frombuffer(r["data"], np.uint8).reshape(6, 9, 3), want)
        assert r["size"] == (tmp_path / f"{n}.png").stat().st_size and r["mtime"] > 0


def _builder(spark):
    """Inference by a stand-in model that finds one object in each picture, and a count of the pictures it saw."""
    seen = spark.sparkContext.accumulator(0)

    def detect(batch):
        seen.add(len(batch))
        out = np.zeros((len(batch), 6, 1), np.float32)
        out[:, :, 0] = [32, 32, 20, 20, 0.9, 0.1]
        return out

    return (lambda rows: etl.infer(rows, detect, ("cat", "dog"), size=64)), seen


def test_refresh_sends_files_once(spark):
    lib, seen = library(spark), spark.sparkContext.accumulator(0)

    def build(rows):
        def run(frames):
            for f in frames:
                seen.add(len(f))
                yield f

        return rows.select("path", "mtime", "size").mapInPandas(run, "path string, mtime bigint, size bigint").join(lib.images.drop("mtime", "size").where("path = 'a.jpg'").drop("path"))

    listing = spark.createDataFrame([(f"{i}.jpg", 1, 1) for i in range(50)] + [("a.jpg", 0, 0)], "path string, mtime bigint, size bigint")
    out = etl.refresh(lib, listing, build)
    assert out.images.count() == 51 and seen.value == 50
    assert len({o["obj_id"] for r in out.images.collect() for o in r["objects"]}) == 102


def test_library_follows_a_folder(spark, tmp_path):
    build, seen = _builder(spark)
    root, at = tmp_path / "in", str(tmp_path / "lib")
    root.mkdir()
    follow = lambda fingerprint="one": folder.follow_folder(spark, str(root), at, "m", build, str(tmp_path / "cp"), fingerprint=fingerprint, files=2).awaitTermination(120)
    for i in range(5):
        (root / f"{i}.png").write_bytes(png(_picture(i)))
    (root / "bad.png").write_bytes(b"no picture")
    follow()
    rows = {r["path"]: r for r in versions.read(spark, at, "m").collect()}
    assert seen.value == 5 and sorted(rows) == [f"{i}.png" for i in range(5)] and versions.version(spark, at, "m").number == 2
    ids = {p: r["img_id"] for p, r in rows.items()}
    assert sorted(ids.values()) == list(range(5)) and len({o["obj_id"] for r in rows.values() for o in r["objects"]}) == 5
    assert all(r["img_attrs"]["width"] == 9 and r["objects"][0]["class"] == "cat" for r in rows.values())
    follow()
    assert seen.value == 5
    (root / "9.png").write_bytes(png(_picture(9)))
    follow()
    assert seen.value == 6 and versions.read(spark, at, "m").count() == 6
    # the same batch once more: in force already, so neither built nor written
    rows = pictures.read_pictures(spark, str(root))
    last = versions.version(spark, at, "m")
    assert folder.absorb(rows, at, "m", build, fingerprint="one", batch=last.batch) == last and seen.value == 6
    # files that are known are not built again, unless by another model
    folder.absorb(rows, at, "m", build, fingerprint="one")
    assert seen.value == 6
    folder.absorb(rows, at, "m", build, fingerprint="two")
    assert seen.value == 12 and versions.version(spark, at, "m").fingerprint == "two"
    assert ids.items() <= {r["path"]: r["img_id"] for r in versions.read(spark, at, "m").collect()}.items()


def test_keyed_state(spark, tmp_path):
    """Late rows, deletions, a failed batch that is run again, and tombstones that end."""
    schema = "id bigint, ts timestamp, n bigint, gone boolean, v string"

    def run(rows, keep=60_000, before=None):
        df = spark.createDataFrame(rows, "id bigint, s bigint, n bigint, gone boolean, v string").select("id", F.timestamp_seconds("s").alias("ts"), "n", "gone", "v")
        if rows:
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        changes = keyed.taking_effect(stream, "id", "ts", "n", "gone", keep, "100 seconds")
        keyed.log(changes, str(tmp_path / "log"), str(tmp_path / "cp"), before).awaitTermination(120)
        return {r["id"]: r["v"] for r in keyed.table(spark, str(tmp_path / "log"), "id", ["ts", "n"], "gone").collect()}

    assert run([(1, 1000, 1, False, "a"), (1, 1000, 2, False, "b"), (2, 1000, 1, False, "c")]) == {1: "b", 2: "c"}

    def fail(number):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        run([(1, 990, 9, False, "old"), (2, 1010, 1, True, ""), (3, 1010, 1, False, "d")], before=fail)
    assert run([(2, 1005, 1, False, "late")]) == {1: "b", 3: "d"}
    written = spark.read.parquet(str(tmp_path / "log"))
    assert written.where("v in ('old', 'late')").count() == 0
    # time goes on: the tombstone of 2 ends, and the key may start anew
    run([(4, 2000, 1, False, "e")])
    assert run([(4, 2001, 1, False, "f")]) == {1: "b", 3: "d", 4: "f"}
    assert run([(2, 1999, 1, False, "new")]) == {1: "b", 2: "new", 3: "d", 4: "f"}


def _plain_resample(p, height, width):
    """The kernel pixel by pixel."""

    def cubic(d):
        d = abs(d)
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0

    def line(x, new):
        old, out = len(x), []
        for i in range(new):
            at, wide = (i + 0.5) * old / new - 0.5, max(1.0, old / new)
            near = range(int(at - 2 * wide) - 2, int(at + 2 * wide) + 3)
            w = [cubic((j - at) / wide) for j in near]
            out.append(sum(c * x[min(max(j, 0), old - 1)] for c, j in zip(w, near, strict=True)) / sum(w))
        return np.array(out)

    p = line(p.astype(float), height)
    p = np.swapaxes(line(np.swapaxes(p, 0, 1), width), 0, 1)
    return np.clip(np.floor(p + 0.5), 0, 255)


@pytest.mark.parametrize("size", [(6, 9), (12, 5), (3, 4), (1, 1), (17, 30)])
def test_resampling(size):
    p = _picture(4)
    got = pixels.resample(p, *size)
    assert np.abs(got.astype(int) - _plain_resample(p, *size)).max() <= 1 and (got != _plain_resample(p, *size)).mean() < 0.02
    assert size != (6, 9) or np.array_equal(got, p)
    assert (pixels.resample(np.full((7, 5, 3), 90, np.uint8), *size) == 90).all()


def test_letterbox_rounds():
    box, scale, left, top = pixels.letterbox(_picture(5), 16)
    assert scale == 16 / 9 and (left, top) == (0, 2)  # 6 rows become 10.67, so 11
    assert np.allclose(box[:, 1] * 255, 114) and not np.allclose(box[:, 2] * 255, 114) and not np.allclose(box[:, 12] * 255, 114) and np.allclose(box[:, 13] * 255, 114)


def test_scenes(spark):
    x = pixels.softmax(np.array([[1000.0, 1000.0, -1000.0]]))
    assert np.allclose(x, [[0.5, 0.5, 0]])
    assert np.allclose(pixels.scene_input(np.full((5, 4, 3), 255, np.uint8))[:, 0, 0], (1 - pixels.MEANS) / pixels.DEVIATIONS)
    rows = spark.createDataFrame([("a.png", 1, 1, 6, 9, bytearray(_picture(1).tobytes()), None)], "path string, mtime bigint, size bigint, height int, width int, data binary, exif map<string,string>")
    calls = spark.sparkContext.accumulator(0)

    def scenes(batch):
        calls.add(len(batch))
        out = np.zeros((len(batch), 365), np.float32)
        out[:, 3] = 10
        return out

    made = etl.completed(etl.infer(rows, lambda b: np.zeros((len(b), 6, 1), np.float32), ("cat", "dog"), size=32, scenes=scenes), Library(library(spark).images, library(spark).collections, (), tuple(f"s{i}" for i in range(365)))).collect()[0]
    assert made["img_attrs"]["dominant_scene"] == "s3" and calls.value == 1 and made["img_attrs"]["indoor_score"] == pytest.approx(1, abs=0.02)


@pytest.mark.parametrize("step", [512, 3])
def test_suppression_of_rows(spark, monkeypatch, step):
    """Against the plain kernel, with groups that span Arrow batches and one group that holds most rows."""
    monkeypatch.setattr(detect, "STEP", step)
    rng = np.random.default_rng(6)
    rows = [(int(min(rng.integers(0, 9), 2)), int(rng.integers(0, 2)), i, *map(float, rng.uniform(0.05, 0.5, 4).round(2))) for i in range(500)]
    df = spark.createDataFrame([*rows, (0, 0, 999, None, 0.1, 0.1, 0.1)], "p int, k int, id int, x double, y double, w double, h double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {r["id"] for r in detect.suppressed(df, 0.3, ["p", "k"], [F.col("id")]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for g in {r[:2] for r in rows}:
        left = sorted((r for r in rows if r[:2] == g), key=lambda r: (-(r[5] * r[6]), r[2]))
        for r in left:
            if all(detect._overlap(np.array([r[3:]]), np.array([o[3:]]))[0, 0] <= 0.3 for o in left if o[2] in want):
                want.add(r[2])
    assert got == want and detect.suppressed(df.limit(0), 0.3, ["p"], []).count() == 0


def test_decoding_of_rows(spark):
    raw = np.zeros((6, 3), np.float32)
    raw[:, 0], raw[:, 1], raw[:, 2] = [32, 32, 32, 16, 0.9, 0.1], [200, 32, 8, 8, 0.9, 0.1], [32, 32, 8, 8, 0.1, 0.2]
    rows = [(i, *map(float, raw[:4, i]), raw[4:, i].tolist(), 0.64, 0, 16, 100, 50) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, cx double, cy double, w double, h double, scores array<float>, scale double, left int, top int, width int, height int")
    (r,) = detect.decoded(df, 0.25).collect()
    ((k, c, *box),) = pixels.decode(raw, 0.25, 0.64, 0, 16, 100, 50)
    assert (r["id"], r["k"], r["confidence"]) == (0, k, pytest.approx(c)) and [r[c] for c in "xywh"] == pytest.approx(box)


def test_embeddings_of_objects(spark):
    lib = library(spark)
    shown = spark.createDataFrame([(p, 6, 9, bytearray(_picture(i).tobytes())) for i, p in enumerate(("a.jpg", "b.jpg"))], "path string, height int, width int, data binary")
    pack = Pack("face", "animal", input_size=4, can_extract_embedding=True, embedding_name="face", can_cluster=True, cluster_name="face", cluster_threshold=0.999)

    def model():
        return lambda x: x.reshape(len(x), -1)[:, :12]

    out = embed.clustered(lib, pack, lambda o: embed.crops(o, shown, pack), model, [3, 4, 4])
    got = {o["class"]: o for r in out.images.collect() for o in r["objects"]}
    assert len(got["cat"]["embeddings"]["face"]) == 12 and np.linalg.norm(got["dog"]["embeddings"]["face"]) == pytest.approx(1)
    assert got["cat"]["cluster_ids"]["face"] == "face_animal_001" and got["dog"]["cluster_ids"]["face"] == "face_animal_002" and not got["person"]["embeddings"]
    with pytest.raises(QueryError):
        embed.parents(lib, Pack("off", "animal"))


def test_runs(spark, tmp_path):
    at = str(tmp_path / "runs")
    new = library(spark).images.select("path", "mtime", "size")
    for i, old in enumerate((new.limit(0), new, new, new)):
        change, seen = runs.observed(old, new)
        assert change.count() == 4
        runs.record(spark, at, min(i, 2), seen)
    r = runs.hit_ratio(runs.history(spark, at)).first()
    assert (r["runs"], r["hits"], r["ratio"]) == (3, 2, pytest.approx(2 / 3))
    assert runs.hit_ratio(runs.history(spark, at).limit(0)).first()["ratio"] is None


def test_vectors_are_sent_once_to_a_block(spark):
    """Random directions rule nothing out: each vector visits every earlier cell, but goes to few blocks."""
    n = 3000
    x = np.random.default_rng(4).normal(size=(n, 16))
    c = cluster.cells(_items(spark, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)), 0.3)
    assert len(c.count) > 50 and len(c.low) == 2
    assert c.meetings().count() <= n * (len(c.low) + 1)


@pytest.mark.parametrize("block", [2048, 60])
def test_density_equals_brute_force(spark, monkeypatch, block):
    """Core, border and noise; a product that only single precision puts on the threshold's other side."""
    monkeypatch.setattr(cluster, "BLOCK", block)
    x = np.random.default_rng(5).normal(size=(400, 6))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = x.astype(np.float64) @ x.astype(np.float64).T
    near = np.triu(s, 1)
    t = float(near[np.unravel_index(np.abs(near - 0.93).argmin(), near.shape)])  # a pair stands exactly on it
    links = s >= t - 1e-15
    np.fill_diagonal(links, False)
    core = links.sum(1) >= 2
    want = _groups(len(x), [(i * 3, j * 3) for i, j in zip(*np.nonzero(np.triu(links & core[:, None] & core[None])), strict=True)])
    want = {i * 3: want[i * 3] if core[i] else min((want[j * 3] for j in np.flatnonzero(links[i] & core)), default=None) for i in range(len(x))}
    assert None in want.values() and any(want[i * 3] is not None for i in np.flatnonzero(~core))
    got = {r["id"]: r["comp"] for r in cluster.density(_items(spark, x), t - 1e-15, 3).collect()}
    assert got == want
