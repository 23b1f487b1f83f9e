"""EXIF fields of a JPEG, by its own parts: application segment, header, directories."""

from __future__ import annotations

import struct

#: Tags of the fields that are read.
MAKE, MODEL, DATE, EXIF, EXPOSURE, APERTURE, ISO, TAKEN, FOCAL = 0x010F, 0x0110, 0x0132, 0x8769, 0x829A, 0x829D, 0x8827, 0x9003, 0x920A
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _segment(data: bytes) -> bytes:
    at = 2
    if data[:2] != b"\xff\xd8":
        return b""
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if kind == 0xDA:
            break
        at += 2 + size
    return b""


def _directory(t: bytes, at: int, order: str) -> dict:
    out = {}
    (n,) = struct.unpack_from(order + "H", t, at)
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", t, at + 2 + 12 * i)
        size = _SIZES.get(kind, 0) * count
        where = at + 10 + 12 * i
        if size > 4:
            (where,) = struct.unpack_from(order + "I", t, where)
        raw = t[where : where + size]
        if not size or len(raw) < size:
            continue
        if kind == 2:
            out[tag] = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (3, 4, 9):
            out[tag] = struct.unpack_from(order + {3: "H", 4: "I", 9: "i"}[kind], raw)[0]
        elif kind in (5, 10):
            a, b = struct.unpack_from(order + ("II" if kind == 5 else "ii"), raw)
            out[tag] = a / b if b else -1.0
    return out


def read(data: bytes) -> dict:
    """Camera, exposure and date fields; those that are missing or broken are left out."""
    t = _segment(data)
    order = {b"II": "<", b"MM": ">"}.get(t[:2])
    try:
        if order is None or struct.unpack_from(order + "H", t, 2)[0] != 42:
            return {}
        tags = _directory(t, struct.unpack_from(order + "I", t, 4)[0], order)
        if EXIF in tags:
            tags |= {k: v for k, v in _directory(t, tags[EXIF], order).items() if k not in tags}
    except struct.error:
        return {}
    out = {k: tags[v] for k, v in (("camera_make", MAKE), ("camera_model", MODEL), ("shutter_speed", EXPOSURE), ("aperture", APERTURE), ("iso", ISO), ("focal_length", FOCAL)) if v in tags}
    if date := tags.get(DATE) or tags.get(TAKEN):
        out["datetime_original"] = date
    return out
