"""Fuzzy scores as Columns: single-precision memberships between 0 and 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def score(x) -> Column:
    return (F.lit(x) if not isinstance(x, Column) else x).cast("float")


def sigmoid(z: Column, k: float = 10.0) -> Column:
    return (1.0 / (1.0 + F.exp(-k * z))).cast("float")


def gauss(d: Column, sigma: float) -> Column:
    return F.exp(-(d * d) / (2 * sigma * sigma))


def clamp(x: Column) -> Column:
    """Into [0, 1]; NaN stays."""
    x = x.cast("float")
    return F.when(x < score(0), score(0)).when((x > score(1)) & ~F.isnan(x), score(1)).otherwise(x)


def larger(a: Column, b: Column) -> Column:
    """``b`` if it is greater, else ``a``; NaN is greater than nothing."""
    return F.when((b > a) & ~F.isnan(b), b).otherwise(a)


def smaller(a: Column, b: Column) -> Column:
    return F.when((b < a) & ~F.isnan(a), b).otherwise(a)


def positive(s: Column) -> Column:
    return (s > score(0)) & ~F.isnan(s)


#: Hue centres of the named colours, in degrees.
HUES = {"red": 0, "orange": 30, "yellow": 60, "green": 120, "cyan": 180, "blue": 220, "purple": 270, "pink": 330}
BINS, BIN = 32, 11.25


def colour(wanted: Column | str, named: Column, s: Column, v: Column, hist: Column) -> Column:
    """Membership in a named colour: by name, by the five hue bins around its centre, or by greyness."""
    name = F.lit(wanted) if isinstance(wanted, str) else wanted

    def band(hue: int) -> Column:
        mid = int(hue / BIN + 0.5)
        bins = [F.coalesce(F.get(hist, (mid + d) % BINS), F.lit(0.0)).cast("float") for d in range(-2, 3)]
        return clamp(reduce(Column.__add__, bins))

    grey, at = s < 0.15, score
    rule = {c: band(h) for c, h in HUES.items()}
    rule["gray"] = F.when(grey & (v > 0.15) & (v < 0.85), at(1)).otherwise(at(0))
    rule["white"] = F.when(grey & (v > 0.85), at(1)).otherwise(at(0))
    rule["black"] = F.when(v < 0.15, at(1)).otherwise(at(0))
    if isinstance(wanted, str):
        rest = rule.get(wanted, at(0))
    else:
        rest = at(0)
        for c, value in rule.items():
            rest = F.when(name == c, value).otherwise(rest)
    return F.when(named == name, at(1)).otherwise(rest)


def once(c: Column) -> Column:
    """The same, worked out once a row: what columns tell alone the optimizer repeats in each filter and column that reads it."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def cosine(a: Column, b: Column) -> Column:
    """Similarity of two histograms in double precision; a zero one is like none."""
    real = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda t, x: t + f(x))
    square = lambda v: total(v, lambda x: real(x) * real(x))
    sums = F.struct(total(F.zip_with(a, b, lambda p, q: real(p) * real(q)), lambda x: x).alias("pq"), F.sqrt(square(a)).alias("p"), F.sqrt(square(b)).alias("q"))

    def share(t: Column) -> Column:
        return F.when((t["p"] <= 1e-12) | (t["q"] <= 1e-12), score(0)).otherwise(clamp(t["pq"] / (t["p"] * t["q"])))

    # the sums stand in a list of one, so that they are made once
    return F.get(F.transform(F.array(sums), share), F.lit(0))


def number(s: Column) -> Column:
    """The number that a text begins with, else 0."""
    found = F.regexp_extract(s, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def root(x: Column) -> Column:
    return F.when(x < 0, F.lit(float("nan"))).otherwise(F.sqrt(x))


def normal_label(name: str) -> str:
    """ASCII lower case, blanks and hyphens as underscores."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "_" if c in " -" else c for c in name)
