"""JSON documents read in chunks, and results written by tasks."""

import gzip
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.golden import library
from vistaset import catalog
from vistaset.errors import QueryError
from vistaset.session import Session
from vistaset.sources import library as sources
from vistaset.sources import pages, pieces

ENTRIES = {
    f'p"{i}\\{{,é.jpg': {"mtime": i, "img_id": i, "img_attrs": {"camera_make": 'q\\"},{[' * (i % 5), "user_tags": {"k,": "v]"}}, "objects": [{"class": "a,b", "x": 0.5}] * (i % 3)}
    for i in range(60)
}
DOC = {"version": "1.2", "x": {"a": {"b": [1, {"c": '}"\\'}]}}, "entries": ENTRIES | {"long": {"mtime": 7, "img_attrs": {"camera_make": "\\" * 3000 + '"'}}}, "collections": {'al"b': ["p1", "p2"], "e": []}, "tail": []}


@pytest.mark.parametrize(("indent", "ascii_", "chunk"), [(None, True, 997), (2, False, 1501), (None, False, 1 << 20)])
def test_chunked_index_equals_the_document(spark, tmp_path, indent, ascii_, chunk):
    (tmp_path / "i.json").write_text(json.dumps(DOC, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    doc = pieces.Document(spark, str(tmp_path / "i.json"), chunk)
    assert doc.parts == -(-os.path.getsize(tmp_path / "i.json") // chunk) and doc.values("version") == ["1.2"]
    assert {r["key"]: json.loads(r["value"]) for r in doc.section("entries").collect()} == DOC["entries"]
    assert {r["key"]: json.loads(r["value"]) for r in doc.section("x").collect()} == DOC["x"] and doc.section("tail").count() == 0 == doc.section("none").count()
    images, albums = sources.read_index(spark, str(tmp_path / "i.json"), chunk)
    assert {r["path"]: r["img_attrs"]["camera_make"] for r in images.collect()} == {k: v["img_attrs"]["camera_make"] for k, v in DOC["entries"].items()}
    assert sorted(map(tuple, albums.collect())) == [('al"b', 0, "p1"), ('al"b', 1, "p2")]


def test_chunked_list_keeps_its_order(spark, tmp_path):
    names = [f'n{i}{"[" * (i % 4)}' for i in range(200)]
    (tmp_path / "l.json").write_text(json.dumps({"images": [{"path": n} for n in names]}))
    assert {r["img_id"]: r["path"] for r in sources.read_legacy(spark, str(tmp_path / "l.json"), 301).collect()} == dict(enumerate(names))


def test_broken_documents_are_refused(spark, tmp_path):
    text = json.dumps(DOC)
    for k, bad in enumerate((text[: len(text) // 2], text[:-1], '{"version": "1.2')):
        (tmp_path / f"{k}.json").write_text(bad)
        with pytest.raises(QueryError):
            sources.read_index(spark, str(tmp_path / f"{k}.json"), 700)


def test_written_index_reads_back(spark, tmp_path):
    images = library(spark).images
    sources.write_index(images.repartition(3), str(tmp_path / "w"))
    assert not [n for n in os.listdir(tmp_path / "w") if n.startswith("_writing")] and "_SUCCESS" in os.listdir(tmp_path / "w")
    back, _ = sources.read_index(spark, f"{tmp_path}/w/part-*.json", 4096)
    told = lambda d: sorted(map(str, d.select("path", "img_id", F.to_json("objects").alias("o"), F.to_json("img_attrs").alias("a")).collect()))
    assert told(back) == told(images.select(*back.columns))


def test_packed_index_reads_back(spark, tmp_path, monkeypatch):
    """Parts are gzip files of many frames, read in chunks that do not match them."""
    monkeypatch.setattr(pages, "FRAME", 1500)
    with open(tmp_path / "frames.gz", "wb") as f:
        p = pages.PackedOut(f)
        for k in range(3000):
            p.write(b"%d," % k)
        p.flush()
    plain = b"".join(b"%d," % k for k in range(3000))
    assert gzip.decompress((tmp_path / "frames.gz").read_bytes()) == plain
    with pieces.opened(f"file:{tmp_path}/frames.gz") as f:
        assert f.size() == len(plain) and len(f.places) > 5
        assert all(f.read_at(n, at) == plain[at : at + n] for n, at in ((1, 0), (4000, 700), (10, len(plain) - 5), (len(plain), 0)))
    images = library(spark).images
    sources.write_index(images.repartition(3), str(tmp_path / "w"), packed=True)
    sources.write_index(images.repartition(3), str(tmp_path / "p"))
    size = lambda d, end: sum(os.path.getsize(tmp_path / d / n) for n in os.listdir(tmp_path / d) if n.endswith(end))
    assert 0 < size("w", ".json.gz") < size("p", ".json") / 4
    back, _ = sources.read_index(spark, f"{tmp_path}/w/part-*.json.gz", 4096)
    told = lambda d: sorted(map(str, d.select("path", "img_id", F.to_json("objects").alias("o"), F.to_json("img_attrs").alias("a")).collect()))
    assert told(back) == told(images.select(*back.columns))


def test_document_takes_few_jobs(spark, tmp_path):
    """F1 of round 4: chunks are told of at once, not by a job for each, one after the other."""
    (tmp_path / "i.json").write_text(json.dumps(DOC))
    sc = spark.sparkContext
    sc.setJobGroup("few", "few")
    try:
        doc = pieces.Document(spark, str(tmp_path / "i.json"), 200)
        jobs = len(sc.statusTracker().getJobIdsForGroup("few"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert doc.parts > 50 and jobs < 12
    assert {r["key"]: json.loads(r["value"]) for r in doc.section("entries").collect()} == DOC["entries"]


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [f"c{i}" for i in range(len(rows[0]))])


@pytest.mark.parametrize("packed", [False, True])
def test_chunks_of_every_size_tell_the_same(tmp_path, monkeypatch, packed):
    doc = {'a\\"': {'k"\\': '\\\\"},{', "l": [1, [2, {"m": "]"}], {}]}, "b": {}, "\\": '"', "c,": [",", "\\"]}
    text = json.dumps({"e": doc}, indent=1).encode()
    name = tmp_path / ("d.json.gz" if packed else "d.json")
    for size in (*range(1, 40), 1000):
        if packed:  # frames of that size
            monkeypatch.setattr(pages, "FRAME", size)
            with open(name, "wb") as f:
                out = pages.PackedOut(f)
                for k in range(len(text)):
                    out.write(text[k : k + 1])
                if out.n:
                    out.flush()
        else:
            name.write_bytes(text)
        cuts = [tuple(r.values()) for b in pieces._cut(3 if packed else size)([_batch([(f"file:{name}", len(text))])]) for r in b.to_pylist()]
        assert cuts[0][1] == 0 and cuts[-1][2] == len(text) == cuts[0][4] and all(a[2] == b[1] for a, b in zip(cuts, cuts[1:], strict=False))
        starts, inside, depth = [], False, 0
        for cut, t in zip(cuts, next(pieces._told([_batch(cuts)])).to_pylist(), strict=True):
            starts.append((*cut, inside, depth, text.index(b":"), len(text) - 2))
            assert (t["low_within"] if inside else t["low"]) <= 0
            depth += t["within"] if inside else t["outside"]
            inside ^= t["flips"]
        assert (inside, depth) == (False, 0)
        rows = [r for b in pieces._members(2)([_batch(starts)]) for r in b.to_pylist()]
        assert {json.loads(r["key"]): json.loads(r["value"]) for r in rows} == doc and len(rows) == 4


def test_packed_chunks_are_whole_frames(tmp_path, monkeypatch):
    """A chunk is unpacked alone and once: no headers of other frames are looked at, and what follows only as far as is read."""
    monkeypatch.setattr(pages, "FRAME", 1 << 18)
    plain = b"".join(b"%d," % k for k in range(300_000))
    with open(tmp_path / "f.gz", "wb") as f:
        p = pages.PackedOut(f)
        for k in range(0, len(plain), 1000):
            p.write(plain[k : k + 1000])
        p.flush()
    uri = f"file:{tmp_path}/f.gz"
    with pieces.opened(uri) as f:
        cuts = f.cuts(1 << 18)
    assert len(cuts) == -(-len(plain) // 263_000) and b"".join(plain[a:b] for a, b, _ in cuts) == plain
    for start, stop, place in cuts[:-1]:
        with pieces.opened(uri, start, place) as f:
            assert f.read_at(stop - start, start) == plain[start:stop] and len(f.places) == 1
            assert f.read_at(100, stop) == plain[stop : stop + 100] and len(f.places) == 2 and len(f.held[1]) <= 100
            assert f.read_at(50_000, stop) == plain[stop : stop + 50_000] and f.read_at(10, max(0, start - 5)) == plain[max(0, start - 5) :][:10]


def test_written_texts_keep_their_places(spark, tmp_path, monkeypatch):
    """Texts are joined a frame of them at a time; nulls are empty ones, and long ones stand alone."""
    monkeypatch.setattr(pages, "FRAME", 10)
    texts = ["a", None, "", "é" * 30, "bc", "x" * 9, "y", None]
    for between in ("", ",\n"):
        found = list(pages._joined(pa.array(texts), between))
        assert between.join(bytes(b).decode() for _, b in found) == between.join(t or "" for t in texts) and sum(n for n, _ in found) == len(texts) and len(found) > 3
    assert list(pages._joined(pa.array([], pa.string()), ",")) == []


def test_empty_index_has_no_entries(spark, tmp_path):
    images = library(spark).images.where("path = 'none'")
    sources.write_index(images, str(tmp_path / "e"), packed=True)
    assert sources.read_index(spark, f"{tmp_path}/e/part-*.json.gz")[0].count() == 0


def test_answers_and_reports_in_files(spark, tmp_path):
    s = Session(library(spark))
    answer = s.run("$ any person")
    answer.write_json(str(tmp_path / "a"))
    rows = [r for n in sorted(os.listdir(tmp_path / "a")) if n.endswith(".json") for r in json.loads((tmp_path / "a" / n).read_text())["images"]]
    assert rows == json.loads(answer.json())["images"]
    with pytest.raises(FileExistsError):
        answer.write_json(str(tmp_path / "a"))
    with pytest.raises(QueryError):
        s.run("cnt(person)").write_json(str(tmp_path / "b"))
    cards = spark.createDataFrame([("a<b>.jpg", 0.75, "red", "x & y", "", "k='v'"), ("b.jpg", 0.5, None, "", "", "")], "path string, score double, colour string, objects string, scenes string, tags string")
    catalog.write_report(cards.coalesce(1), str(tmp_path / "r"), "T<")
    page = (tmp_path / "r" / "part-000000.html").read_text()
    assert "<title>T&lt;</title>" in page and "a&lt;b&gt;.jpg 0.750" in page and "x &amp; y" in page and page.count("<div>") == 2 and page.endswith("</html>")


def test_failed_tasks_leave_nothing(spark, tmp_path):
    texts = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("text"))
    with pytest.raises(Exception, match="no"):
        pages.write(texts, str(tmp_path / "f"), pages.Form("[", ",", "]", ".json"))
    assert os.listdir(tmp_path / "f") == []
    pages.write(spark.range(0).select(F.col("id").cast("string").alias("text")), str(tmp_path / "e"), pages.Form("[", ",", "]", ".json"))
    assert not [n for n in os.listdir(tmp_path / "e") if n.startswith("_writing")]
