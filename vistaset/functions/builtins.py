"""Built-in functions of the language: each takes (compiler, argument nodes, scope)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans import nodes as n
from ..plans.values import Value
from ..sources.schema import HUES, LUMAS, SCENES
from . import fuzzy as fz

TABLE: dict = {}
_IMAGE = "img_attrs."


def _need(name: str, args: tuple, count: int) -> None:
    if len(args) != count:
        raise QueryError(f"{name} takes {count} arguments")


def _typed(c, node, s, kind: str, name: str) -> Column:
    v = c.expr(node, s)
    if v.kind != kind:
        raise QueryError(f"{name} needs a {kind}")
    return v.col


def _const(c, node, s, name: str) -> str:
    """A text known when compiling."""
    if not isinstance(node, n.Text):
        raise QueryError(f"{name} needs a text literal")
    return node.value


# -- numbers ------------------------------------------------------------------------------------

_MATH = {
    "max": (2, lambda a, b: F.when(a < b, b).otherwise(a)),
    "min": (2, lambda a, b: F.when(b < a, b).otherwise(a)),
    "abs": (1, F.abs),
    "sqrt": (1, fz.root),
    "pow": (2, F.pow),
    "log": (1, fz.log),
    "exp": (1, F.exp),
}


def _math(name, count, f):
    def call(c, args, s):
        _need(name, args, count)
        return Value("num", f(*[_typed(c, a, s, "num", name) for a in args]))

    return call


TABLE |= {k: _math(k, *v) for k, v in _MATH.items()}


def _stof(c, args, s):
    _need("stof", args, 1)
    return Value("num", fz.number(_typed(c, args[0], s, "text", "stof")))


def _contains(c, args, s):
    _need("str_contains", args, 2)
    a, b = (_typed(c, x, s, "text", "str_contains") for x in args)
    return Value("score", F.contains(a, b).cast("float"))


TABLE |= {"stof": _stof, "str_contains": _contains}


# -- colours of an object ------------------------------------------------------------------------


def _object(c, args, s, name) -> tuple[Column, tuple]:
    """The object argument, or the current one; and the arguments that are left."""
    if args and not isinstance(args[0], n.Text):
        if c.bare_class(args[0], s):
            o = c.best(args[0].name, s)
            if o is not None:
                return o, args[1:]
        v = c.expr(args[0], s)
        if v.kind == "object":
            return v.col, args[1:]
    if s.obj is None:
        raise QueryError(f"{name} needs an object")
    return s.obj, args


def _color(c, args, s):
    o, rest = _object(c, args, s, "color")
    if not rest:
        raise QueryError("color needs a colour name")
    wanted = rest[0].value if isinstance(rest[0], n.Text) else _typed(c, rest[0], s, "text", "color")
    a = o["attr"]
    return Value("score", F.coalesce(fz.colour(wanted, a["dominant_color_name"], a["s"], a["v"], a["hue_hist"]), fz.score(0)))


def _kelvin(k: Column, low: float, span: float, flip: bool) -> Column:
    share = (k.cast("float") - fz.score(low)) / fz.score(span)
    return fz.clamp(fz.score(1) - share if flip else share)


_OBJECT_COLOURS = {
    "cct": lambda a: _kelvin(a["color_temperature"], 2000, 8000, False),
    "warmth": lambda a: _kelvin(a["color_temperature"], 2000, 6000, True),
    "coolness": lambda a: _kelvin(a["color_temperature"], 2000, 6000, False),
    "brightness": lambda a: fz.clamp(a["v"]),
    "saturation": lambda a: fz.clamp(a["s"]),
}


def _object_colour(name, f):
    def call(c, args, s):
        o, _ = _object(c, args, s, name)
        return Value("score", F.coalesce(f(o["attr"]), fz.score(0)))

    return call


TABLE["color"] = _color
TABLE |= {k: _object_colour(k, f) for k, f in _OBJECT_COLOURS.items()}


# -- whole images --------------------------------------------------------------------------------


def _field(name: str) -> Column:
    return F.col(_IMAGE + name)


def _img(kind, default, value):
    """A value of the current image; without one, the default."""

    def call(c, args, s):
        if not s.image:
            return Value(kind, fz.score(default) if kind == "score" else F.lit(default))
        v = value()
        return Value(kind, F.coalesce(v, fz.score(default) if kind == "score" else F.lit(default)))

    return call


_camera = lambda: F.concat_ws(" ", F.nullif(_field("camera_make"), F.lit("")), F.nullif(_field("camera_model"), F.lit("")))
_num = lambda f: lambda: _field(f).cast("double")
_plain = lambda f: lambda: _field(f).cast("float")
TABLE |= {
    "img_temp": _img("score", 0, lambda: _kelvin(_field("color_temperature"), 2000, 8000, False)),
    "img_warmth": _img("score", 0, lambda: _kelvin(_field("color_temperature"), 2000, 6000, True)),
    "img_coolness": _img("score", 0, lambda: _kelvin(_field("color_temperature"), 2000, 6000, False)),
    "img_bright": _img("score", 0, lambda: fz.clamp(_field("avg_value"))),
    "img_colorful": _img("score", 0, lambda: fz.clamp(_field("avg_saturation") * fz.score(2))),
    "img_over": _img("score", 0, _plain("overexposure_score")),
    "img_under": _img("score", 0, _plain("underexposure_score")),
    "img_exp_good": _img("score", 1, _plain("exposure_goodness")),
    "img_blur": _img("score", 0, _plain("global_blur_score")),
    "img_blurry": _img("score", 1, lambda: fz.clamp(fz.score(1) - _field("global_blur_score"))),
    "img_camera": _img("text", "", _camera),
    "img_iso": _img("num", -1.0, _num("iso")),
    "img_shutter": _img("num", -1.0, _num("shutter_speed")),
    "img_aperture": _img("num", -1.0, _num("aperture")),
    "img_fl": _img("num", -1.0, _num("focal_length")),
    "img_date": _img("text", "", lambda: _field("datetime_original")),
    "img_scene_top": _img("text", "", lambda: _field("dominant_scene")),
    "img_scene_vec": _img("score", 0, lambda: F.array_max(_field("scene_vector")).cast("float")),
    "img_is_indoor": _img("score", 0, lambda: fz.clamp(_field("indoor_score"))),
}


def _zeros() -> Column:
    return F.array_repeat(fz.score(0), HUES)


def _img_hist(c, args, s):
    return Value("hist", F.coalesce(_field("global_hue_hist"), _zeros()) if s.image else _zeros())


def _img_color(c, args, s):
    _need("img_color", args, 1)
    wanted = args[0].value if isinstance(args[0], n.Text) else _typed(c, args[0], s, "text", "img_color")
    if not s.image:
        return Value("score", fz.score(0))
    return Value("score", fz.colour(wanted, _field("dominant_color"), _field("avg_saturation"), _field("avg_value"), _field("global_hue_hist")))


def _tag(c, args, s):
    _need("img_tag", args, 1)
    key = _typed(c, args[0], s, "text", "img_tag")
    return Value("text", F.coalesce(F.try_element_at(_field("user_tags"), key), F.lit("")) if s.image else F.lit(""))


def _has_tag(c, args, s):
    _need("img_has_tag", args, 1)
    key = _typed(c, args[0], s, "text", "img_has_tag")
    return Value("score", F.coalesce(F.map_contains_key(_field("user_tags"), key), F.lit(False)).cast("float") if s.image else fz.score(0))


def _tag_equals(c, args, s):
    _need("img_tag_equals", args, 2)
    key, value = (_typed(c, a, s, "text", "img_tag_equals") for a in args)
    return Value("score", F.coalesce(F.try_element_at(_field("user_tags"), key) == value, F.lit(False)).cast("float") if s.image else fz.score(0))


def _scene(c, args, s):
    """A label's probability: by normal name, first index first; else by whole number."""
    _need("img_scene", args, 1)
    name = _const(c, args[0], s, "img_scene")
    wanted = fz.normal_label(name)
    at = next((i for i, x in enumerate(c.library.labels[:SCENES]) if fz.normal_label(x) == wanted), None)
    if at is None and name.isascii() and name.isdigit() and int(name) < SCENES:
        at = int(name)
    if at is None or not s.image:
        return Value("score", fz.score(0))
    return Value("score", fz.clamp(F.coalesce(F.get(_field("scene_vector"), at), fz.score(0))))


TABLE |= {"img_hist": _img_hist, "img_color": _img_color, "img_tag": _tag, "img_has_tag": _has_tag, "img_tag_equals": _tag_equals, "img_scene": _scene}


# -- histograms ----------------------------------------------------------------------------------


def _subject(c, args, s) -> Column | None:
    """The object that a histogram function speaks of: the best of a class, an object, the current one."""
    if args:
        if c.bare_class(args[0], s):
            return c.best(args[0].name, s)
        v = c.expr(args[0], s)
        if v.kind == "object":
            return v.col
    return s.obj


def _obj_hist(c, args, s):
    o = _subject(c, args, s)
    return Value("hist", _zeros() if o is None else F.coalesce(o["attr"]["hue_hist"], _zeros()))


def _bin(c, node, s, size: int) -> Column:
    """A bin index: numbers are cut to whole ones, others and those out of range are errors."""
    if isinstance(node, n.Number):
        if not 0 <= int(node.value) < size:
            raise QueryError(f"bin index {int(node.value)} is not in 0..{size - 1}")
        return F.lit(int(node.value))
    i = _typed(c, node, s, "num", "bin index").cast("int")
    bad = F.raise_error(F.lit(f"bin index is not in 0..{size - 1}")).cast("int")
    return F.when((i >= 0) & (i < size), i).otherwise(bad)


def _hist_sim(c, args, s):
    _need("hist_sim", args, 2)
    return Value("score", fz.cosine(*[_typed(c, a, s, "hist", "hist_sim") for a in args]))


def _hist_value(c, args, s):
    _need("hist_value", args, 2)
    h = _obj_hist(c, args[:1], s).col
    return Value("score", fz.clamp(F.get(h, _bin(c, args[1], s, HUES))))


def _img_hist_value(c, args, s):
    _need("img_hist_value", args, 1)
    i = _bin(c, args[0], s, HUES)
    return Value("score", fz.clamp(F.get(_img_hist(c, (), s).col, i)))


def _img_hist_val(c, args, s):
    _need("img_hist_val", args, 1)
    i = _bin(c, args[0], s, LUMAS)
    return Value("score", F.coalesce(F.get(_field("luma_hist"), i).cast("float"), fz.score(0)) if s.image else fz.score(0))


def _obj_blur(c, args, s):
    o = _subject(c, args, s)
    return Value("score", fz.score(0) if o is None else fz.clamp(F.coalesce(o["attr"]["local_blur_score"], fz.score(0))))


TABLE |= {"obj_hist": _obj_hist, "hist_sim": _hist_sim, "hist_value": _hist_value, "img_hist_value": _img_hist_value, "img_hist_val": _img_hist_val, "obj_blur": _obj_blur}


# -- clusters ------------------------------------------------------------------------------------


def _cluster_of(c, node, s, name: str) -> Column | None:
    o = _subject(c, (node,), s)
    return None if o is None else F.coalesce(F.try_element_at(o["cluster_ids"], F.lit(name)), F.lit(""))


def _cluster_id(c, args, s):
    _need("cluster_id", args, 2)
    found = _cluster_of(c, args[0], s, _const(c, args[1], s, "cluster_id"))
    if found is None:
        raise QueryError("cluster_id needs an object")
    return Value("text", found)


def _cluster_sim(c, args, s):
    _need("cluster_sim", args, 3)
    name = _const(c, args[2], s, "cluster_sim")
    a, b = (_cluster_of(c, x, s, name) for x in args[:2])
    if a is None or b is None:
        return Value("score", fz.score(0))
    return Value("score", F.when((a != "") & (a == b), fz.score(1)).otherwise(fz.score(0)))


TABLE |= {"cluster_id": _cluster_id, "cluster_sim": _cluster_sim}
