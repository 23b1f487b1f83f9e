"""Measurements of pixels, and detections from a model's raw output; numpy on whole arrays."""

from __future__ import annotations

import numpy as np

#: Upper hue bounds of the named colours, in degrees.
HUE_NAMES = ((15, "red"), (45, "orange"), (70, "yellow"), (150, "green"), (190, "cyan"), (260, "blue"), (290, "purple"), (345, "pink"), (361, "red"))
#: Linear sRGB to XYZ.
XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
SHARP = 3000.0
#: Means and deviations of red, green and blue that scene models are trained with.
MEANS, DEVIATIONS = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)


def hsv(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b, g, r = np.moveaxis(bgr.astype(np.float64) / 255, -1, 0)
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    flat = d <= 1e-6
    e = np.where(flat, 1, d)
    h = np.where(top == r, np.fmod((g - b) / e, 6), np.where(top == g, (b - r) / e + 2, (r - g) / e + 4)) * 60
    h = np.where(flat, 0, np.where(h < 0, h + 360, h))
    return h, np.where(flat, 0, d / np.where(top > 0, top, 1)), top


def colour_names(h: np.ndarray, s: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The named colour of each pixel."""
    h, s, v = (x.astype(np.float32) for x in (h, s, v))
    names = np.array([n for _, n in HUE_NAMES], dtype="U8")
    out = names[np.searchsorted([t for t, _ in HUE_NAMES], h, "right")]
    warm = (h < 45) | (h >= 345)
    out = np.where(warm & (s > np.float32(0.35)) & (v < np.float32(0.55)), "brown", out)
    out = np.where(s < np.float32(0.15), np.where(v > np.float32(0.85), "white", "gray"), out)
    return np.where(v < np.float32(0.15), "black", out)


def most_common(names: np.ndarray) -> str:
    """The most frequent name; ties go to the first in order."""
    found, n = np.unique(names, return_counts=True)
    return str(found[n.argmax()]) if len(found) else ""


def temperature(rgb: np.ndarray) -> float:
    """Correlated colour temperature of a mean sRGB colour, between 2000 and 10000 K; black has none."""
    c = np.clip(rgb, 0, 1)
    xyz = XYZ @ np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    if xyz.sum() < 1e-9:
        return 0.0
    x, y = xyz[:2] / xyz.sum()
    n = (x - 0.3320) / (y - 0.1858)
    return float(np.clip(np.polyval([-449.0, 3525.0, -6823.3, 5520.33], n), 2000, 10000))


def grey(bgr: np.ndarray) -> np.ndarray:
    w = np.array([0.114, 0.587, 0.299], np.float32)
    return bgr.astype(np.float32) @ w


def laplacian_variance(g: np.ndarray) -> float:
    if min(g.shape) < 3:
        return 0.0
    g = g.astype(np.float64)
    lap = 4 * g[1:-1, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:] - g[:-2, 1:-1] - g[2:, 1:-1]
    return float(max(lap.var(), 0.0))


def roughness(g: np.ndarray) -> float:
    """Share of pixels whose ring of eight changes more than twice against the centre."""
    if min(g.shape) < 3:
        return 0.0
    c, h, w = g[1:-1, 1:-1], g.shape[0] - 2, g.shape[1] - 2
    ring = np.stack([g[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] >= c for dy, dx in ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))])
    turns = (ring != np.roll(ring, 1, 0)).sum(0)
    return float(1 - (turns <= 2).mean(dtype=np.float32))


def _hues(h: np.ndarray) -> list[float]:
    return (np.bincount(np.minimum((h / 11.25).astype(int), 31).ravel(), minlength=32) / max(h.size, 1)).astype(np.float32).tolist()


def object_attr(bgr: np.ndarray, box: tuple[float, float, float, float]) -> dict:
    """Appearance of a centred box, in parts of the image."""
    rows, cols = bgr.shape[:2]
    x, y, w, h = box
    x1, y1, x2, y2 = int((x - w / 2) * cols), int((y - h / 2) * rows), int((x + w / 2) * cols), int((y + h / 2) * rows)
    part = bgr[max(0, y1) : min(rows, y2), max(0, x1) : min(cols, x2)]
    if not part.size:
        return {}
    hh, ss, vv = hsv(part)
    g = grey(part).astype(np.uint8)
    sharp = laplacian_variance(g)
    out = {k: float(m.mean()) for k, m in (("h", hh), ("s", ss), ("v", vv))}
    out |= {f"{k}_std": float(m.std()) for k, m in (("h", hh), ("s", ss), ("v", vv))}
    return out | {
        "color_temperature": temperature(part.reshape(-1, 3)[:, ::-1].mean(0) / 255), "dominant_color_name": most_common(colour_names(hh, ss, vv)),
        "hue_hist": _hues(hh), "lbp": roughness(g), "local_blur_score": sharp / (sharp + SHARP),
    }


def image_attrs(bgr: np.ndarray) -> dict:
    """Measurements of a whole image."""
    hh, ss, vv = hsv(bgr)
    g = grey(bgr)
    over, under, sharp = float((g > 240).mean()), float((g < 30).mean()), laplacian_variance(g)
    luma = np.bincount(np.minimum((vv * 255).astype(int) // 4, 63).ravel(), minlength=64) / vv.size
    return {
        "color_temperature": temperature(bgr.reshape(-1, 3)[:, ::-1].mean(0) / 255), "avg_hue": float(hh.mean()), "avg_saturation": float(ss.mean()), "avg_value": float(vv.mean()),
        "dominant_color": most_common(colour_names(hh, ss, vv)), "global_hue_hist": _hues(hh), "luma_hist": luma.astype(np.float32).tolist(),
        "overexposure_score": over, "underexposure_score": under, "exposure_goodness": 1 - (over + under) / 2,
        "global_blur_score": sharp / (sharp + SHARP), "global_blur_raw": sharp, "height": bgr.shape[0], "width": bgr.shape[1],
    }


def _weights(old: int, new: int) -> np.ndarray:
    """(new, old) weights of a cubic kernel along one axis; shrinking widens the kernel, edges repeat."""
    step = old / new
    wide = max(1.0, step)
    at = (np.arange(new) + 0.5) * step - 0.5
    reach = int(np.ceil(2 * wide))
    j = np.floor(at)[:, None].astype(int) + np.arange(-reach, reach + 2)[None]
    d = np.abs(j - at[:, None]) / wide
    # the cubic of slope -1/2: it passes through the pixels and keeps straight lines
    w = np.where(d <= 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0))
    out = np.zeros((new, old))
    np.add.at(out, (np.repeat(np.arange(new), j.shape[1]), j.clip(0, old - 1).ravel()), (w / w.sum(1, keepdims=True)).ravel())
    return out


def resample(bgr: np.ndarray, height: int, width: int) -> np.ndarray:
    """The picture in another size, rounded to whole levels."""
    h, w = bgr.shape[:2]
    p = np.tensordot(_weights(h, height), bgr.astype(np.float64), (1, 0))
    p = np.moveaxis(np.tensordot(_weights(w, width), p, (1, 1)), 0, 1)
    return np.clip(np.floor(p + 0.5), 0, 255).astype(np.uint8)


def letterbox(bgr: np.ndarray, size: int) -> tuple[np.ndarray, float, int, int]:
    """The image scaled into a square with grey borders, as channels first in 0..1; and scale and offsets."""
    h, w = bgr.shape[:2]
    scale = min(size / h, size / w)
    nh, nw = (max(1, int(np.floor(n * scale + 0.5))) for n in (h, w))
    out = np.full((size, size, 3), 114, np.uint8)
    top, left = (size - nh) // 2, (size - nw) // 2
    out[top : top + nh, left : left + nw] = resample(bgr, nh, nw)
    return out[..., ::-1].transpose(2, 0, 1).astype(np.float32) / 255, scale, left, top


def normal(bgr: np.ndarray) -> np.ndarray:
    """Pixels channels first, in units of the usual means and deviations."""
    return ((bgr[..., ::-1].astype(np.float32) / 255 - MEANS) / DEVIATIONS).transpose(2, 0, 1)


def scene_input(bgr: np.ndarray, size: int = 224) -> np.ndarray:
    """The picture squeezed into a square, in a scene model's form."""
    return normal(resample(bgr, size, size))


def softmax(x: np.ndarray) -> np.ndarray:
    """Probabilities of rows of logits; large ones do not overflow."""
    e = np.exp(x.astype(np.float64) - x.max(-1, keepdims=True))
    return (e / e.sum(-1, keepdims=True)).astype(np.float32)


def decode(raw: np.ndarray, conf: float, scale: float, left: int, top: int, width: int, height: int) -> list[tuple]:
    """(class, confidence, x, y, w, h) of a raw output of shape (4 + classes, anchors), in parts of the image."""
    k = raw[4:].argmax(0)
    c = raw[4:].max(0)
    cx, cy, w, h = raw[:4]
    x1, x2 = (np.clip((cx + s * w / 2 - left) / scale, 0, width) for s in (-1, 1))
    y1, y2 = (np.clip((cy + s * h / 2 - top) / scale, 0, height) for s in (-1, 1))
    keep = (c >= conf) & (x2 > x1) & (y2 > y1)
    cols = (k, c, (x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height)
    return list(zip(*(v[keep].tolist() for v in cols), strict=True))


def suppress(boxes: list[tuple], iou: float) -> list[tuple]:
    """Of boxes (class, confidence, x, y, w, h), the larger first, those that overlap no kept one of their class."""
    if not boxes:
        return []
    b = np.array([t[1:] for t in boxes], float)
    kind = np.array([t[0] for t in boxes])
    order = np.argsort(-(b[:, 3] * b[:, 4]), kind="stable")
    alive, out = np.ones(len(b), bool), []
    lo, hi = b[:, 1:3] - b[:, 3:5] / 2, b[:, 1:3] + b[:, 3:5] / 2
    area = b[:, 3] * b[:, 4]
    for i in order:
        if not alive[i]:
            continue
        out.append(boxes[i])
        side = np.maximum(np.minimum(hi[i], hi) - np.maximum(lo[i], lo), 0)
        both = side.prod(1)
        alive &= ~((kind == kind[i]) & (both / np.maximum(area[i] + area - both, 1e-300) > iou))
    return out
