"""Compiles syntax trees to Columns and DataFrames.

Inside a filter everything is a Column of the image's row: objects are a nested array, quantifiers are
array aggregates, macros are inlined, class trees and scene labels are literals. So a filter is one
narrow pass over the library, and only set operations between images shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import fuzzy as fz
from ..operators import sets
from ..sources.library import Library
from . import nodes as n
from .values import Scope, Value, as_score, joined

PROPS = {"class": "text", "x": "num", "y": "num", "w": "num", "h": "num", "area": "num", "confidence": "num", "super_class": "text", "original_class": "text", "attr": "attr"}
ATTRS = {"h": "num", "s": "num", "v": "num", "h_std": "num", "s_std": "num", "v_std": "num", "color_temperature": "num", "dominant_color_name": "text", "lbp": "num", "local_blur_score": "num"}
PLACES = frozenset({"x", "y", "w", "h", "area"})
PAIRS = ("left_of", "above", "inside")
MOST_DEPTH = 64
#: Below this distance a sigmoid rounds to one half in single precision.
SLACK = 1e-8


class Compiler:
    def __init__(self, library: Library, variables: dict[str, Value], macros: dict[str, n.MacroDef], hard: bool = False, tags: Column | None = None, expander=None):
        self.library, self.variables, self.macros = library, variables, macros
        self.hard, self.tags, self.expander = hard, tags, expander

    # -- entry ---------------------------------------------------------------------------------

    def top(self, node: n.Node) -> Value:
        """A whole statement: sets as they are, scalars as one-row DataFrames (column ``value``)."""
        scope = Scope()
        v = self.expr(node, scope)
        if v.is_set or v.kind == "none":
            return v
        spark = self.library.images.sparkSession
        return Value(v.kind, F.col("value"), joined(spark.range(1), scope.frames).select(v.col.alias("value")))

    def expr(self, node: n.Node, s: Scope) -> Value:
        return getattr(self, f"on_{type(node).__name__}")(node, s)

    # -- sources -------------------------------------------------------------------------------

    def whole(self) -> DataFrame:
        rows = self.library.images
        return (rows.where(self.tags) if self.tags is not None else rows).withColumn("score", fz.score(1))

    def on_Library(self, node, s):
        if s.image:
            return Value("images", fz.score(1))
        rows = self.whole()
        return Value("images", df=rows.select("path", "score"), rows=rows)

    def on_Album(self, node, s):
        paths = self.library.collections.where(F.col("name") == node.name).select("path").distinct()
        return Value("images", df=paths.withColumn("score", fz.score(1)))

    def on_ImageObjects(self, node, s):
        if s.objs is not None:
            return Value("objects", sets.scored(s.objs))
        if s.objs_df is not None:
            return Value("objects", df=s.objs_df)
        return Value("objects", df=sets.explode_objects(self.library.images))

    def on_CurrentObject(self, node, s):
        if s.obj is None:
            raise QueryError("obj needs an object in reach")
        return Value("object", s.obj)

    def on_Number(self, node, s):
        return Value("num", F.lit(node.value))

    def on_Text(self, node, s):
        return Value("text", F.lit(node.value))

    # -- names ---------------------------------------------------------------------------------

    def on_Name(self, node, s):
        for frame in s.params:
            if node.name in frame:
                return frame[node.name]
        if s.obj is not None and node.name in PROPS:
            return self.property(s.obj, node.name)
        if node.name in self.variables:
            return self.variable(self.variables[node.name], s)
        m = self.macros.get(node.name)
        if m is not None and len(m.params) == 1 and s.obj is not None:
            return self.inlined(m, [Value("object", s.obj)], s)
        if self.library.known_class(node.name):
            return Value("score", self.member(node.name, s))
        raise QueryError(f"Unknown name {node.name!r}")

    def variable(self, v: Value, s: Scope) -> Value:
        return v if v.is_set or v.kind == "none" else Value(v.kind, s.attach(v.df))

    def property(self, o: Column, name: str) -> Value:
        if name not in PROPS:
            raise QueryError(f"Unknown property {name!r}")
        return Value(PROPS[name], o[name].cast("double") if PROPS[name] == "num" else o[name])

    def on_Member(self, node, s):
        base = self.expr(node.base, s)
        if base.kind == "object":
            return self.property(base.col, node.name)
        if base.kind == "attr":
            if node.name not in ATTRS:
                raise QueryError(f"Unknown attribute {node.name!r}")
            return Value(ATTRS[node.name], base.col[node.name].cast("double") if ATTRS[node.name] == "num" else base.col[node.name])
        raise QueryError(f"{base.kind} has no properties")

    # -- class membership ----------------------------------------------------------------------

    def membership(self, o: Column, name: str) -> Column:
        conf = o["confidence"].cast("float")
        near = (o["confidence"] * 0.800000011920929).cast("float")  # single-precision 0.8
        return F.when(o["class"] == name, conf).when(o["super_class"] == name, near).otherwise(fz.score(0))

    def member(self, name: str, s: Scope) -> Column:
        if s.objs is not None:
            return F.aggregate(s.objs, fz.score(0), lambda a, o: fz.larger(a, self.membership(o, name)))
        if s.objs_df is not None:
            return s.attach(s.objs_df.agg(F.coalesce(F.max(self.membership(F.col("o"), name)), fz.score(0))))
        return fz.score(0)

    def is_kind(self, o: Column, name: str) -> Column:
        if name == "root":
            return F.lit(True)
        return o["class"].isin([name, *self.library.descendants(name)]) | (o["super_class"] == name)

    def on_Count(self, node, s):
        if s.objs is not None:
            return Value("num", F.size(F.filter(s.objs, lambda o: self.is_kind(o, node.name))).cast("double"))
        if s.objs_df is not None:
            return Value("num", s.attach(s.objs_df.agg(F.count(F.when(self.is_kind(F.col("o"), node.name), 1)).cast("double"))))
        # images count within their rows first, so no object is exploded
        n_ = F.size(F.filter("objects", lambda o: self.is_kind(o, node.name)))
        return Value("num", s.attach(self.library.images.agg(F.coalesce(F.sum(n_), F.lit(0)).cast("double"))))

    def best(self, name: str, s: Scope) -> Column | None:
        """The first object of a class with the greatest confidence above 0, or null."""
        if s.objs is None:
            return None
        conf = lambda o: o["confidence"].cast("float")
        mine = F.filter(s.objs, lambda o: self.is_kind(o, name) & (conf(o) > 0))
        most = F.array_max(F.transform(mine, conf))
        return F.get(F.filter(mine, lambda o: conf(o) == most), F.lit(0))

    # -- operators -----------------------------------------------------------------------------

    def on_Unary(self, node, s):
        v = self.expr(node.arg, s)
        if node.op == "!":
            return Value("score", fz.score(1) - as_score(v, s))
        if node.op == "-":
            if v.kind != "num":
                raise QueryError("- needs a number")
            return Value("num", -v.col)
        if node.op == "%":
            if v.kind != "images":
                raise QueryError("% needs a set of images")
            if v.df is None:
                none = F.filter(sets.scored(s.objs), lambda o: F.lit(False))
                return Value("objects", F.when(v.col.isNotNull(), sets.scored(s.objs)).otherwise(none))
            return Value("objects", df=sets.explode_objects(self.image_rows(v)))
        if v.kind != "objects":
            raise QueryError("^ needs a set of objects")
        if v.df is None:
            rank = F.transform(v.col, lambda o: F.when(o["score"] > 0, o["score"]).otherwise(o["confidence"].cast("float")))
            return Value("images", F.array_max(rank))
        return Value("images", df=sets.to_images(v.df))

    def image_rows(self, v: Value) -> DataFrame:
        """The library's rows of a set of images, with their scores."""
        return v.rows if v.rows is not None else self.library.images.join(v.df, "path")

    def on_Binary(self, node, s):
        a, b = self.expr(node.left, s), self.expr(node.right, s)
        op = node.op
        if op == "-" and a.is_set and a.kind == b.kind:
            return self.set_op("-", a, b, s)
        if op in ("&&", "||"):
            x, y = as_score(a, s), as_score(b, s)
            value = F.when(y < x, y).otherwise(x) if op == "&&" else F.when(x < y, y).otherwise(x)
            return Value("score", value, needs=_both(op, a.needs, b.needs), hard_needs=_both(op, _first(a.hard_needs, a.needs), _first(b.hard_needs, b.needs)))
        if a.kind == "text" and b.kind == "text":
            return self.text_test(node, op, a, b, s)
        if a.kind in ("num", "score") and b.kind in ("num", "score"):
            return self.numeric(node, op, a.col.cast("double"), b.col.cast("double"), s)
        raise QueryError("Type mismatch in binary operation")

    def text_test(self, node, op, a, b, s):
        of = node.left.name if isinstance(node.left, (n.Name, n.Member)) else ""
        if op in ("==", "!=") and of in ("class", "super_class") and s.obj is not None:
            o, conf = s.obj, s.obj["confidence"].cast("float")
            near = (o["confidence"] * 0.8).cast("float")
            if of == "class":
                hit = F.when(o["class"] == b.col, conf).when(o["super_class"] == b.col, near).otherwise(fz.score(0))
                needs = (o["class"] == b.col) | (o["super_class"] == b.col)
            else:
                hit = F.when(a.col == b.col, near).otherwise(fz.score(0))
                needs = a.col == b.col
            return Value("score", hit, needs=needs) if op == "==" else Value("score", fz.score(1) - hit)
        same = a.col != b.col if op == "!=" else a.col == b.col
        return Value("score", same.cast("float"), needs=same)

    def numeric(self, node, op, a, b, s):
        counts = isinstance(node.left, n.Count)
        if op in ("+", "-", "*"):
            return Value("num", {"+": a + b, "-": a - b, "*": a * b}[op])
        if op == "/":
            return Value("num", F.when(b == 0, F.raise_error(F.lit("Division by zero")).cast("double")).otherwise(a / F.when(b == 0, F.lit(None)).otherwise(b)))
        if op in ("==", "!="):
            if counts:
                most = F.when(a < b, b).otherwise(a)
                e = F.when(most <= 0, fz.score(1)).otherwise(fz.clamp(1 - F.abs(a - b) / F.when(most > 0, most)))
                return Value("score", e if op == "==" else fz.clamp(fz.score(1) - e))
            place = isinstance(node.left, (n.Name, n.Member)) and node.left.name in PLACES
            g = fz.gauss(a - b, 0.05 if place else 0.1)
            return Value("score", (g if op == "==" else 1 - g).cast("float"))
        # counts compare with two and a half whatever stands on the right
        if op in (">", ">="):
            b = F.lit(2.5) if counts and op == ">" else b
            return Value("score", fz.sigmoid(a - b), hard_needs=a >= b - SLACK)
        if op in ("<", "<="):
            b = F.lit(2.5) if counts and op == "<" else b
            return Value("score", fz.sigmoid(b - a), hard_needs=b >= a - SLACK)
        raise QueryError("Type mismatch in binary operation")

    def on_SetOp(self, node, s):
        a, b = self.expr(node.left, s), self.expr(node.right, s)
        if a.kind in ("score", "num") and b.kind in ("score", "num") and node.op != "-":
            x, y = as_score(a, s), as_score(b, s)
            return Value("score", F.when(y < x, y).otherwise(x) if node.op == "&" else F.when(x < y, y).otherwise(x))
        if not (a.is_set and a.kind == b.kind):
            raise QueryError("Set operation on different types")
        return self.set_op(node.op, a, b, s)

    def set_op(self, op, a, b, s):
        if a.df is not None and b.df is not None:
            f = {("images", "|"): sets.union_images, ("images", "&"): sets.intersect_images, ("images", "-"): sets.subtract_images}
            f |= {("objects", "|"): sets.union_objects, ("objects", "&"): sets.intersect_objects, ("objects", "-"): sets.subtract_objects}
            return Value(a.kind, df=f[a.kind, op](a.df, b.df, self.library.tasks))
        if a.df is not None or b.df is not None:
            raise QueryError("A set of the current image and one of the library do not combine inside a condition")
        if a.kind == "images":
            x, y = a.col, b.col
            out = {"|": F.greatest(x, y), "&": F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)), "-": F.when(y.isNull(), x)}[op]
            return Value("images", out)
        return Value("objects", {"|": sets.union_arrays, "&": sets.intersect_arrays, "-": sets.subtract_arrays}[op](a.col, b.col))

    # -- filters and quantifiers ---------------------------------------------------------------

    def in_image(self, s: Scope) -> Scope:
        return Scope(image=True, objs=F.col("objects"), obj=s.obj if s.image else None, params=s.params, depth=s.depth)

    def on_Filter(self, node, s):
        src = self.expr(node.source, s)
        if src.kind != "images":
            raise QueryError("Filter needs a set of images on its left")
        if src.df is None:
            c = as_score(self.expr(node.condition, s), s)
            keep = c >= fz.score(0.5) if self.hard else fz.positive(c)
            return Value("images", F.when(src.col.isNotNull() & keep & ~F.isnan(c), c))
        inner = self.in_image(s)
        c = self.expr(node.condition, inner)
        return self.kept(src, as_score(c, inner), inner, _first(c.hard_needs, c.needs) if self.hard else c.needs)

    def kept(self, src: Value, value: Column, inner: Scope, needs: Column | None) -> Value:
        """Images with a positive score (hard: at least one half), their score replaced."""
        rows = self.image_rows(src)
        names = rows.columns
        if needs is not None and not inner.frames:
            rows = rows.where(needs)
        rows = joined(rows, inner.frames).withColumn("score", fz.once(value))
        rows = rows.where(fz.positive(F.col("score")))
        if self.hard:
            rows = rows.where(F.col("score") >= fz.score(0.5))
        rows = rows.select(*names)
        return Value("images", df=rows.select("path", "score"), rows=rows)

    def over(self, kind: str, objs: Column, cond: n.Node, s: Scope, rebind: bool = True) -> Value:
        """Greatest (any) or least (all) score of a condition over an array of objects."""
        found: dict = {}

        def one(o: Column) -> Column:
            return as_score(self.expr(cond, s.inner(obj=o, objs=objs if rebind else s.objs)), s)

        def need(o: Column) -> Column:
            v = self.expr(cond, s.inner(obj=o, objs=objs if rebind else s.objs))
            found["needs"] = v.needs is not None
            return v.needs if v.needs is not None else F.lit(True)

        # scores are listed first: a step reads its score several times
        value = F.aggregate(F.transform(objs, one), fz.score(1 if kind == "all" else 0), fz.larger if kind == "any" else fz.smaller)
        needs = None
        if kind == "any":
            before = len(s.frames)
            test = F.exists(objs, need)
            needs = test if found.get("needs") and len(s.frames) == before else None
        return Value("score", value, needs=needs)

    def over_rows(self, kind: str, df: DataFrame, cond: n.Node, s: Scope) -> Value:
        """The same over a DataFrame of objects; a one-row result."""
        inner = Scope(objs_df=df, obj=F.col("o"), params=s.params, depth=s.depth)
        c = as_score(self.expr(cond, inner), inner)
        c = F.when(~F.isnan(c), c)
        rows = joined(df, inner.frames)
        agg = F.greatest(F.coalesce(F.max(c), fz.score(0)), fz.score(0)) if kind == "any" else F.least(F.coalesce(F.min(c), fz.score(1)), fz.score(1))
        return Value("score", s.attach(rows.agg(agg)))

    def on_Quantified(self, node, s):
        if node.source is None:
            if s.objs is not None:
                return self.over(node.kind, s.objs, node.condition, s, rebind=False)
            if s.objs_df is not None:
                return self.over_rows(node.kind, s.objs_df, node.condition, s)
            return Value("score", fz.score(1 if node.kind == "all" else 0))
        src = self.expr(node.source, s)
        if src.kind == "objects":
            return self.over(node.kind, src.col, node.condition, s) if src.df is None else self.over_rows(node.kind, src.df, node.condition, s)
        if src.kind != "images":
            raise QueryError(f"{node.kind} needs a set on its left")
        if src.df is None:
            v = self.over(node.kind, s.objs, node.condition, s)
            keep = v.col >= fz.score(0.5) if self.hard else fz.positive(v.col)
            return Value("images", F.when(src.col.isNotNull() & keep, v.col))
        inner = self.in_image(s)
        v = self.over(node.kind, F.col("objects"), node.condition, inner)
        return self.kept(src, v.col, inner, v.needs)

    def on_Expand(self, node, s):
        src = self.expr(node.source, s)
        if src.kind != "objects" or src.df is None:
            raise QueryError(">> needs a set of objects outside a condition")
        if self.expander is None:
            raise QueryError("no predictors are registered")
        return Value("objects", df=self.expander(src.df, node.pack))

    # -- calls ---------------------------------------------------------------------------------

    def on_Call(self, node, s):
        from ..functions import builtins

        if node.name in PAIRS and len(node.args) == 2 and all(self.bare_class(a, s) for a in node.args):
            return Value("score", self.pairs(node.name, node.args[0].name, node.args[1].name, s))
        m = self.macros.get(node.name)
        if m is not None:
            if len(node.args) != len(m.params):
                raise QueryError(f"{node.name} takes {len(m.params)} arguments")
            return self.inlined(m, [self.expr(a, s) for a in node.args], s)
        f = builtins.TABLE.get(node.name)
        if f is None:
            raise QueryError(f"Unknown function {node.name!r}")
        return f(self, node.args, s)

    def bare_class(self, a: n.Node, s: Scope) -> bool:
        return isinstance(a, n.Name) and self.library.known_class(a.name) and not any(a.name in p for p in s.params) and a.name not in self.variables

    def inlined(self, m: n.MacroDef, args: list[Value], s: Scope) -> Value:
        """The body with arguments bound in front of all outer ones: scoping is dynamic."""
        if s.depth >= MOST_DEPTH:
            raise QueryError(f"{m.name} nests too deep")
        return self.expr(m.body, s.inner(params=(dict(zip(m.params, args, strict=True)), *s.params), depth=s.depth + 1))

    def pairs(self, relation: str, one: str, two: str, s: Scope) -> Column:
        """Best pair of different objects of two classes in a spatial relation."""
        if s.objs is None:
            if s.objs_df is not None:
                raise QueryError(f"{relation} of classes needs the objects of an image")
            return fz.score(0)
        of = lambda c: F.filter(F.transform(s.objs, lambda o, i: F.struct(i.alias("i"), self.membership(o, c).alias("m"), o["x"].alias("x"), o["y"].alias("y"), o["w"].alias("w"), o["h"].alias("h"))), lambda t: t["m"] > 0)
        first, second = of(one), of(two)

        def near(a: Column, b: Column) -> Column:
            if relation == "left_of":
                return fz.sigmoid(b["x"] - (a["x"] + a["w"]), 20)
            if relation == "above":
                return fz.sigmoid(b["y"] - (a["y"] + a["h"]), 20)
            side = lambda p, q: F.least(a[p] + a[q] / 2, b[p] + b[q] / 2) - F.greatest(a[p] - a[q] / 2, b[p] - b[q] / 2)
            wide, high, own = side("x", "w"), side("y", "h"), a["w"] * a["h"]
            return F.when((wide > 0) & (high > 0) & (own > 0), (wide * high / F.when(own > 0, own)).cast("float")).otherwise(fz.score(0))

        def pair(t: Column, a: Column, b: Column) -> Column:
            both = F.when(a["i"] != b["i"], F.least(a["m"], b["m"], near(a, b))).otherwise(fz.score(0))
            return fz.larger(t, both)

        return F.aggregate(first, fz.score(0), lambda t, a: fz.larger(t, F.aggregate(second, fz.score(0), lambda u, b: pair(u, a, b))))


def _first(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a


def _both(op: str, a: Column | None, b: Column | None) -> Column | None:
    if op == "&&":
        return a if b is None else b if a is None else a & b
    return None if a is None or b is None else a | b


def tag_predicate(specs: list[str]) -> Column | None:
    """``key`` or ``key=a|b``: all keys must fit, by any of their values; no value: the key exists."""
    tags, out = F.col("img_attrs.user_tags"), []
    for spec in specs:
        key, _, values = spec.partition("=")
        has = F.map_contains_key(tags, F.lit(key))
        out.append(has & tags[key].isin(values.split("|")) if values else has)
    return F.coalesce(reduce(Column.__and__, out), F.lit(False)) if out else None


