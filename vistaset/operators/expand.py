"""``objects >> pack``: children that a pack's model finds within parent objects.

The model is a plug-in: a callable from a pandas frame of parents (their fields, and ``crop``, the
padded box as x1, y1, x2, y2 in parts of the image) to one list per parent of (class index, score,
x1, y1, x2, y2), the box in parts of the crop. It runs per Arrow batch, so a worker loads it once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..sources.library import Library, Pack
from ..sources.schema import OBJECT, empty

_FOUND = "image_path string, parent struct<obj_id:bigint,img_id:bigint,class:string,confidence:double,score:float>, class string, conf double, x double, y double, w double, h double, n int"


#: Ids kept for the children of one parent.
CHILDREN = 1 << 20


def padded(x: float, y: float, w: float, h: float, padding: float) -> tuple[float, float, float, float]:
    """A centred box with padding on each side, clipped to the image."""
    dw, dh = w * (1 + 2 * padding) / 2, h * (1 + 2 * padding) / 2
    return max(0.0, x - dw), max(0.0, y - dh), min(1.0, x + dw), min(1.0, y + dh)


def children(pack: Pack, found: list, crop: tuple) -> list[tuple[str, float, float, float, float, float]]:
    """Children of one parent: a classifier gives its best class at the crop, a detector every box that is sure enough."""
    x1, y1, x2, y2 = crop
    cw, ch = x2 - x1, y2 - y1
    out = []
    if pack.is_classifier:
        found = sorted(found, key=lambda f: -f[1])[:1]
    for k, conf, *box in found:
        if conf < pack.conf_threshold or not 0 <= int(k) < len(pack.children):
            continue
        a, b, c, d = (0.0, 0.0, 1.0, 1.0) if pack.is_classifier or not box else box
        out.append((pack.children[int(k)], float(conf), x1 + (a + c) / 2 * cw, y1 + (b + d) / 2 * ch, (c - a) * cw, (d - b) * ch))
    return out


def expander(library: Library, predictors: dict[str, Callable]):
    """The function that the compiler calls for ``>>``."""

    def expand(objects: DataFrame, name: str) -> DataFrame:
        pack = library.packs.get(name)
        if pack is None:
            raise QueryError(f"unknown extension pack {name!r}")
        if not pack.active:
            raise QueryError(f"extension pack {name!r} is not active")
        if pack.can_extract_embedding or pack.can_cluster:
            return objects
        if not library.known_class(pack.parent_class):
            raise QueryError(f"parent class {pack.parent_class!r} of {name!r} is unknown")
        model = predictors.get(name)
        if model is None:
            raise QueryError(f"no model for extension pack {name!r}")
        o = F.col("o")
        parents = objects.where((o["class"] == pack.parent_class) | (o["super_class"] == pack.parent_class))
        flat = parents.select("image_path", "score", *[o[c].alias(c) for c in ("obj_id", "img_id", "class", "confidence", "x", "y", "w", "h")])

        def run(frames):
            for f in frames:
                crops = [padded(*t, pack.crop_padding) for t in zip(f.x, f.y, f.w, f.h, strict=True)]
                out = []
                for r, kind, crop, found in zip(f.itertuples(index=False), f["class"], crops, model(f.assign(crop=crops)), strict=True):
                    parent = {"obj_id": r.obj_id, "img_id": r.img_id, "class": kind, "confidence": r.confidence, "score": np.float32(r.score)}
                    out += [(r.image_path, parent, *c, i) for i, c in enumerate(children(pack, found, crop))]
                yield pd.DataFrame(out, columns=["image_path", "parent", "class", "conf", "x", "y", "w", "h", "n"])

        got = flat.mapInPandas(run, _FOUND)
        p = F.col("parent")
        rank = F.when(p["score"] > 0, p["score"]).otherwise(p["confidence"].cast("float"))
        # ids: below zero and unique per parent, so that they meet no detected object's
        own = -(p["obj_id"] * CHILDREN + F.col("n") + 2)
        child = empty(
            OBJECT, **{"class": F.col("class")}, x=F.col("x"), y=F.col("y"), w=F.col("w"), h=F.col("h"), area=F.col("w") * F.col("h"),
            confidence=F.col("conf"), original_class=F.col("class"), super_class=p["class"], parent_id=p["obj_id"], obj_id=own, img_id=p["img_id"],
        )
        score = (rank.cast("double") * 0.8999999761581421).cast("float")  # single-precision 0.9
        return got.select("image_path", child.alias("o"), score.alias("score"))

    return expand
