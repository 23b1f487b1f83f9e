import pytest

from tests.golden import library
from vistaset.errors import QueryError
from vistaset.plans import nodes as n
from vistaset.plans.parser import parse
from vistaset.session import Session

GOLDEN = [
    ('$ : (any(class == "cat"))', {"a": 0.9}),
    ("$ : (all(area > 0.05))", {"a": 0.524979, "b": 0.401312, "c": 1.0, "d": 0.956893}),
    ("$ : (any(big))", {"a": 0.268941, "b": 0.141851, "d": 0.832018}),
    ("$ : (cnt(fruit) > 2)", {"a": 1.388794e-11, "b": 0.993307, "c": 1.388794e-11, "d": 1.388794e-11}),
    ("$ : (cnt(fruit) >= 3)", {"a": 9.357623e-14, "b": 0.5, "c": 9.357623e-14, "d": 9.357623e-14}),
    ("$ : (cnt(fruit) == 2)", {"b": 0.666667}),
    ("$ : (fruit)", {"b": 0.56}),
    ("$ : (left_of(cat, dog))", {"a": 0.8}),
]
HARD = [("$ : (all(area > 0.05))", "acd"), ("$ : (any(big))", "d"), ("$ : (cnt(fruit) >= 3)", "b")]


@pytest.fixture(scope="module")
def lib(spark):
    return library(spark)


def scores(session, text):
    return {r["path"][0]: r["score"] for r in session.run(text).table().collect()}


@pytest.mark.parametrize("text,expected", GOLDEN)
def test_golden(lib, text, expected):
    got = scores(Session(lib), text)
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-5)


@pytest.mark.parametrize("text,expected", HARD)
def test_hard(lib, text, expected):
    assert "".join(sorted(scores(Session(lib, hard=True), text))) == expected


def test_shorthands_agree(lib):
    s = Session(lib)
    want = scores(s, '$ : (any(class == "cat"))')
    for text in ("$ any cat", '$ any "cat"', '$ any (class == "cat")', '$ (class == "cat")', "$ : (any cat)", "(^ (% ($ any cat))) & ($ any cat)"):
        assert scores(s, text) == want


def test_sets(lib):
    s = Session(lib)
    assert scores(s, "($ any cat) | ($ any person)") == pytest.approx({"a": 0.9, "d": 0.95})
    assert scores(s, "($ any cat) & $") == pytest.approx({"a": 0.9})
    assert sorted(scores(s, "$ - ($ any cat)")) == ["b", "c", "d"]
    assert scores(s, 'collection("trip")') == {"a": 1.0, "g": 1.0}
    assert scores(s, 'collection("trip") : (any cat)') == pytest.approx({"a": 0.9})
    assert scores(s, 'collection("none")') == {}


def test_object_sets(lib):
    s = Session(lib)
    assert s.run("% $").objects().count() == 6
    assert scores(s, "^ % $") == pytest.approx({"a": 0.9, "b": 0.7, "d": 0.95})
    assert s.run("(% ($ any cat)) | (% $)").objects().count() == 6
    assert s.run("(% $) & (% ($ any cat))").objects().count() == 2
    assert s.run("(% $) - (% ($ any cat))").objects().count() == 4
    assert s.run("(% $) any (class == \"dog\")").table().first()[0] == pytest.approx(0.8)
    assert scores(s, "$ : ((% $) any (class == \"dog\"))") == pytest.approx({"a": 0.8})


def test_scalars_and_variables(lib):
    s = Session(lib)
    assert s.run("cnt(fruit)").table().first()[0] == 3
    assert s.run("1 + 2 * 3 - 4 / 2").table().first()[0] == 5
    assert s.run("max(1, 2) + sqrt(4) + abs(-1)").table().first()[0] == 5
    assert s.run('stof("12.5kg")').table().first()[0] == 12.5
    assert scores(s, "cats = $ any cat; dogs = $ any dog; out = cats & dogs; $") == pytest.approx({"a": 0.8})
    with pytest.raises(QueryError):
        s.run("cats = $")


def test_macros(lib):
    s = Session(lib)
    s.run("macro twice(a) = a + a; macro near(p) = p.x > lim; macro f(lim) = any(near(obj))", use_out=False)
    assert s.run("twice(4)").table().first()[0] == 8
    assert scores(s, "$ : (f(0.6))").keys() >= {"a", "b"}
    with pytest.raises(QueryError):
        s.run("twice(1, 2)")


def test_tags(lib):
    assert sorted(scores(Session(lib, tags=["place=home|work"]), "$")) == ["a"]
    assert sorted(scores(Session(lib, tags=["place"]), "$")) == ["a"]
    assert scores(Session(lib, tags=["place=work"]), "$") == {}
    assert scores(Session(lib), '$ : (img_tag("place") == "home")') == {"a": 1.0}
    assert scores(Session(lib), '$ : (img_has_tag("place"))') == {"a": 1.0}


@pytest.mark.parametrize("text", ["nothing", "% 1", "^ $", "1 : (2)", "$ & 1 & (% $)", 'img_scene(1)', "$ : (any(colour))", "color()", 'big(1, 2)', "img_hist_value(32)"])
def test_type_errors(lib, text):
    with pytest.raises(QueryError):
        Session(lib).run(text)


def test_division_by_zero_fails(lib):
    with pytest.raises(Exception, match="(?i)zero"):
        Session(lib).run("1 / 0").table().collect()


def test_broken_statement_is_skipped(lib):
    s = Session(lib)
    assert s.run("1 + ; 2 + 3").table().first()[0] == 5
    assert len(s.errors) == 1
    assert s.run_json("1 +") == '{"type": "scalar", "value": null}'
    assert '"error"' in s.run_json("nothing")
    assert s.run_json("$ any cat").startswith('{"type": "images", "images": [{"path": "a.jpg"')


def test_delete(lib):
    s = Session(lib, allow_delete=True)
    assert s.run("del ($ any cat)").table().first()[0] == 1
    assert sorted(scores(s, "$")) == ["b", "c", "d"]
    assert s.library.collections.count() == 1
    with pytest.raises(QueryError):
        Session(lib).run('del "a.jpg"')


def test_grammar():
    (e,) = parse("% a | b")
    assert isinstance(e, n.Unary) and isinstance(e.arg, n.SetOp)
    (e,) = parse("$ : (x) & $")
    assert isinstance(e, n.Filter) and isinstance(e.condition, n.SetOp)
    (e,) = parse("a = 1.2.3 # note")
    assert e == n.Assign("a", n.Number(1.2))
    (e,) = parse(r'"a\"b"')
    assert e == n.Text('a"b')
    assert [type(x) for x in parse("? ; 1; any 2; 3")] == [n.Broken, n.Number, n.Broken, n.Number]
