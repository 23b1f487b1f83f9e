"""What expressions compile to, and the scope they compile in."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import clamp, score


@dataclass(frozen=True)
class Value:
    """A scalar is a Column; a set is a DataFrame, or within an image a Column of that image.

    kinds: num, score, text, object, attr, hist, none; images: ``df`` (path, score) with ``rows`` (the
    same with the images' own columns) where known, or ``col`` (score of the current image, null if
    it is not in the set); objects: ``df`` (image_path, o, score) or ``col`` (array of o with score).
    ``needs``: a plain predicate without which a score is 0 (or, hard, below one half).
    """

    kind: str
    col: Column | None = None
    df: DataFrame | None = None
    rows: DataFrame | None = None
    needs: Column | None = None
    hard_needs: Column | None = None

    @property
    def is_set(self) -> bool:
        return self.kind in ("images", "objects")


@dataclass(frozen=True)
class Scope:
    """What is in reach: the current image's columns, objects, object, macro arguments.

    ``frames`` collects one-row DataFrames that the expression refers to; whoever evaluates it joins
    them on. It is shared by the scopes within one evaluation.
    """

    image: bool = False
    objs: Column | None = None
    objs_df: DataFrame | None = None
    obj: Column | None = None
    params: tuple[dict, ...] = ()
    frames: list = field(default_factory=list)
    depth: int = 0

    def inner(self, **changes) -> Scope:
        return replace(self, **changes)

    def attach(self, one_row: DataFrame) -> Column:
        """The single value of a one-row, one-column DataFrame, as a Column."""
        name = f"_scalar_{id(self.frames)}_{len(self.frames)}"
        self.frames.append(one_row.toDF(name))
        return F.col(name)


def joined(df: DataFrame, frames: list) -> DataFrame:
    """``df`` with the one-row frames beside every row: one row each by construction."""
    for f in frames:
        df = df.crossJoin(F.broadcast(f))
    return df


def as_score(v: Value, scope: Scope) -> Column:
    if v.kind == "score":
        return v.col
    if v.kind == "num":
        return clamp(v.col)
    if v.kind == "object":
        return score(1)
    if v.is_set:
        if v.df is not None:
            return scope.attach(v.df.limit(1).agg(F.count(F.lit(1)).cast("float")))
        full = v.col.isNotNull() if v.kind == "images" else F.size(v.col) > 0
        return F.when(full, score(1)).otherwise(score(0))
    return score(0)
