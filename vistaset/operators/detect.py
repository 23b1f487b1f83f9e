"""Raw detections as rows: decoding by Column expressions, suppression in sorted partitions.

An anchor is a row, so a model's output needs no task that holds a whole picture. Suppression is greedy and so has
an order, within one class of one picture; a task streams its sorted rows and holds the kept boxes of one such
group, which the anchors of a picture bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decoded(anchors: DataFrame, conf: float) -> DataFrame:
    """Boxes of anchors (cx, cy, w, h in pixels of the model's input; scores; scale, left, top; width, height of the picture).

    Adds k (the first best class) and confidence, and x, y, w, h in parts of the picture; anchors whose best score is
    less than ``conf``, and boxes that lie outside the picture, go. Null scores count as none.
    """
    best = F.array_max("scores")
    span = lambda c, side, off, size: [F.greatest(F.lit(0.0), F.least(F.col(size).cast("double"), (F.col(c) + s * F.col(side) / 2 - F.col(off)) / F.col("scale"))) for s in (-1, 1)]
    (x1, x2), (y1, y2) = span("cx", "w", "left", "width"), span("cy", "h", "top", "height")
    a = anchors.where(best >= conf).select("*", (F.array_position("scores", best) - 1).cast("int").alias("k"), best.alias("confidence"), x1.alias("_x1"), x2.alias("_x2"), y1.alias("_y1"), y2.alias("_y2"))
    a = a.where("_x2 > _x1 and _y2 > _y1")
    keep = [c for c in anchors.columns if c not in ("cx", "cy", "w", "h", "scores", "scale", "left", "top", "width", "height")]
    part = lambda v, size: (v / F.col(size)).alias
    x, y = (F.col("_x1") + F.col("_x2")) / 2, (F.col("_y1") + F.col("_y2")) / 2
    return a.select(*keep, "k", "confidence", part(x, "width")("x"), part(y, "height")("y"), part(F.col("_x2") - F.col("_x1"), "width")("w"), part(F.col("_y2") - F.col("_y1"), "height")("h"))


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (x, y, w, h), each of ``a`` with each of ``b``."""
    a, b = a[:, None], b[None]
    side = [np.minimum(a[..., i] + a[..., i + 2] / 2, b[..., i] + b[..., i + 2] / 2) - np.maximum(a[..., i] - a[..., i + 2] / 2, b[..., i] - b[..., i + 2] / 2) for i in (0, 1)]
    both = np.where((side[0] > 0) & (side[1] > 0), side[0] * side[1], 0.0)
    union = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union != 0)


#: Boxes of a group that are compared at a time.
STEP = 512


def suppressed(boxes: DataFrame, iou: float, group: list[str], ties: list[Column]) -> DataFrame:
    """The boxes (x, y, w, h) that overlap no larger kept one of their group by more than ``iou``; equal areas go by ``ties``."""
    columns = boxes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, kept = None, np.empty((0, 4))
        for b in batches:
            if not b.num_rows:
                continue
            box = np.column_stack([b[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("x", "y", "w", "h")])
            keys = list(zip(*(b[g].to_pylist() for g in group), strict=True))
            new = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            out = []
            for s, e in zip(new, new[1:], strict=False):
                if keys[s] != of:
                    of, kept = keys[s], np.empty((0, 4))
                for i in range(s, e, STEP):
                    part = box[i : min(i + STEP, e)]
                    free = ~(_overlap(part, kept) > iou).any(1)
                    hit = _overlap(part, part) > iou
                    for j in range(len(part)):
                        if free[j]:
                            free[j + 1 :] &= ~hit[j, j + 1 :]
                    out.append(i + np.flatnonzero(free))
                    kept = np.concatenate([kept, part[free]])
            yield b.take(pa.array(np.concatenate(out))).select(columns)

    area = F.col("w") * F.col("h")
    whole = boxes.where(" and ".join(f"{c} is not null" for c in ("x", "y", "w", "h")))
    return whole.repartition(*group).sortWithinPartitions(*group, area.desc(), *ties).mapInArrow(run, boxes.schema)
