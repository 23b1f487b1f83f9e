"""Operators 11 to 13 against brute force, and on odd and empty tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaset.llm import collocations, descent, lines, vector_codes
from vistaset.llm.common import ship

SF = "/root/testdata/sf0.001"


def matches(spark, query, sql, *tables):
    db = duckdb.connect()
    for t in tables:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = db.sql(sql), query(spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize(
    ("query", "sql", "of"), [(vector_codes.op11_vector_codes, vector_codes.SQL, "embeddings"), (collocations.op12_collocations, collocations.SQL, "documents"), (lines.op13_lines, lines.SQL, "documents")]
)
def test_sql(spark, query, sql, of):
    ship(spark)
    matches(spark, query, sql, of)


# vectors
def plain_codes(rows, entries, rounds):
    """{(vec_id, vector): (code, error)} of vectors of one length, by full search."""
    d = len(rows[0][1])
    most = vector_codes.limit(d)
    x = {i: [min(max(math.floor(1024 * c), -most), most) for c in v] for i, (_, v) in enumerate(rows)}
    cut = [k * d // 4 for k in range(5)]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    code, error = defaultdict(str), Counter()
    for a, b in zip(cut, cut[1:], strict=False):
        book = [x[i][a:b] for i in first]
        near = lambda p: min(range(len(book)), key=lambda j: (sum((s - t) ** 2 for s, t in zip(p, book[j], strict=True)), j))
        for _ in range(rounds):
            mine = defaultdict(list)
            for i in x:
                mine[near(x[i][a:b])].append(x[i][a:b])
            for j, ps in mine.items():
                book[j] = [sum(c) // len(ps) for c in zip(*ps, strict=True)]
        for i in x:
            j = near(x[i][a:b])
            code[i] += f"{j:02x}"
            error[i] += sum((s - t) ** 2 for s, t in zip(x[i][a:b], book[j], strict=True))
    return sorted((rows[i][0] is None, rows[i][0] or 0, code[i], error[i]) for i in x)


@pytest.mark.parametrize(("length", "spread"), [(8, 1.0), (6, 0.01), (8, 900000.0)])
def test_vector_codes_by_full_search(spark, length, spread):
    """Ties (small spread: equal integers), lengths that four does not divide, numbers beyond doubles' exact products, equal and null ids."""
    ship(spark)
    rng = np.random.default_rng(3)
    rows = [(i // 2 if i % 7 else None, [float(np.float32(c)) for c in rng.normal(0, spread, length)]) for i in range(600)]
    df = spark.createDataFrame([(i, v, i and i % 3) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    codes, _ = vector_codes.compress(df)
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"]) for r in codes.collect())
    assert got == plain_codes(rows, 256, 4)


def test_odd_vectors(spark):
    ship(spark)
    rows = [(1, None, 0), (2, [0.1, None], 0), (3, [float("nan")] * 4, 0), (4, [float("inf")] * 4, 0), (5, [], None), (6, [0.5] * 4, None), (6, [0.5] * 4, None), (7, [0.25] * 5, 1), (8, [1e30] * 4, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, length string")
    out = vector_codes.with_label_error(vector_codes.compress(df)[0])
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in out.collect()}
    assert out.count() == 5 and got == {5: ("00000000", 0, 0), 6: ("00000000", 0, 0), 7: ("00000000", 0, 0), 8: ("02020202", 0, 0)}
    assert vector_codes.with_label_error(vector_codes.compress(df.limit(0))[0]).count() == 0


# phrases
def plain_phrases(rows, least, places):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inside = lambda g, q: any(q[i : i + len(g)] == g for i in range(len(q) - len(g) + 1))
        found = []
        for g, a in good.items():
            if any(len(q) > len(g) and 100 * b >= 80 * a and inside(g, q) for q, b in good.items()):
                continue
            score, k = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, l_, r, n[lang], -s) for i, (s, a, p, l_, r) in enumerate(sorted(found)[:places], 1)]
    return sorted(out)


def test_phrases_by_full_count(spark, odd, none):
    ship(spark)
    rng = np.random.default_rng(5)
    words = ["New", "york", "city", "hall", "of", "the", "ÉA", "日本", "a\tb", "x."]
    rows = [(["en", None, "und", ""][i % 4], " ".join(rng.choice(words, 60, p=[0.2, 0.2, 0.15, 0.1, 0.1, 0.1, 0.05, 0.04, 0.03, 0.03]))) for i in range(40)] + [("en", None), ("en", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "lang string, text string, phrase string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, least=8, places=30).collect()))
    assert got == plain_phrases(rows, 8, 30) and len({r[0] for r in got}) == 3
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, collocations.collocations(odd, least=2).collect())) == plain_phrases(rows, 2, 2000)
    assert collocations.collocations(none).count() == 0


def test_full_bitmap_loses_nothing(spark, docs, monkeypatch):
    ship(spark)
    few = docs.limit(60)
    want = sorted(map(tuple, collocations.collocations(few, least=6).collect()))
    monkeypatch.setattr(collocations, "sieve", lambda _: np.full(1 << (collocations.BITS - 3), 255, np.uint8))
    assert sorted(map(tuple, collocations.collocations(few, least=6).collect())) == want


# lines
def plain_lines(rows, length, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(-math.inf if doc is None else doc)
    out = []
    for doc, text in rows:
        x = (text or "").split("\n")
        gone = [len(key(a)) >= length and len(held[key(a)]) >= least and max(held[key(a)]) != (-math.inf if doc is None else doc) for a in x]
        out.append((-1 if doc is None else doc, len(x), sum(gone), "\n".join(a for a, g in zip(x, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("local", [lines.LOCAL, 0])
def test_lines_by_full_count(spark, odd, none, local, monkeypatch):
    """Both ways of probing; several shards and several parts of a shard."""
    ship(spark)
    monkeypatch.setattr(lines, "SHARD", 20)
    monkeypatch.setattr(lines, "ASKED", 40)
    rng = np.random.default_rng(1)
    some = [f"{'line number ' if i % 3 else ' Line NUMBER '}{i} é" + "\r" * (i % 2) for i in range(80)] + [""]
    rows = [(None if i % 19 == 0 else i // 2, None if i == 5 else "\n".join(rng.choice(some, rng.integers(0, 30)))) for i in range(120)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(3)
    tell = lambda d: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in d.collect())
    assert tell(lines.without_common_lines(df, 15, 5, local)) == plain_lines(rows, 15, 5)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert tell(lines.without_common_lines(odd, 4, 2, local)) == plain_lines(rows, 4, 2)
    assert lines.without_common_lines(none, local=local).count() == 0


def test_places_are_minimal_and_perfect():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    a[:100] = a[0]  # pairs that share a half
    at = lines.Places(a, b)(a, b)
    assert sorted(at.tolist()) == list(range(5000))


def test_digests(spark, docs):
    ship(spark)
    r = lines.op13_lines(spark, SF).where("n_dropped = 0").first()
    text = docs.where(F.col("doc_id") == r["doc_id"]).first()["text"]
    assert hashlib.sha256((text or "").encode()).hexdigest() == r["kept_sha256"]


# neighbours
def test_neighbours_of_equal_ids(spark):
    """A null copy takes nothing away; an id with two vectors asks with both and is found by both."""
    ship(spark)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(40, None), (40, rows[40][1]), (20, rng.normal(size=4).astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in descent.nearest(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    use = {(i, tuple(v)) for i, v in rows if v}
    for q in (0, 20, 40):
        want = []
        for i, v in use:
            if i == q:
                near = sorted((-sum(float(a) * float(b) for a, b in zip(v, w, strict=True)), j) for j, w in use if j != q)[:20]
                want += [(k, j, s) for k, (s, j) in enumerate(near, 1)]
        assert [(k, j) for k, j, _ in sorted(got[q])] == [(k, j) for k, j, _ in sorted(want, key=lambda t: (t[0], t[1]))]
        assert sorted(s for *_, s in got[q]) == pytest.approx(sorted(-s for *_, s in want))
