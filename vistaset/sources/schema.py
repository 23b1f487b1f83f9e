"""Schemas of the image library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HUES, LUMAS, SCENES = 32, 64, 365

ATTR = (
    "struct<h:float,s:float,v:float,h_std:float,s_std:float,v_std:float,color_temperature:float,"
    "dominant_color_name:string,hue_hist:array<float>,lbp:float,local_blur_score:float>"
)
OBJECT = (
    "struct<class:string,x:double,y:double,w:double,h:double,area:double,confidence:double,original_class:string,"
    "super_class:string,is_fallback:boolean,parent_id:bigint,obj_id:bigint,img_id:bigint,"
    f"attr:{ATTR},embeddings:map<string,array<float>>,cluster_ids:map<string,string>>"
)
IMAGE_ATTRS = (
    "struct<color_temperature:float,avg_hue:float,avg_saturation:float,avg_value:float,dominant_color:string,"
    "global_hue_hist:array<float>,luma_hist:array<float>,overexposure_score:float,underexposure_score:float,"
    "exposure_goodness:float,global_blur_score:float,global_blur_raw:float,camera_make:string,camera_model:string,"
    "iso:float,shutter_speed:float,aperture:float,focal_length:float,datetime_original:string,width:int,height:int,"
    "user_tags:map<string,string>,cluster_groups:map<string,array<string>>,scene_vector:array<float>,"
    "dominant_scene:string,indoor_score:float>"
)
IMAGES = f"path string, mtime bigint, size bigint, img_id bigint, img_attrs {IMAGE_ATTRS}, objects array<{OBJECT}>"
COLLECTIONS = "name string, pos int, path string"

#: Values that stand for a missing field.
DEFAULTS = {
    "exposure_goodness": 1.0, "iso": -1.0, "shutter_speed": -1.0, "aperture": -1.0, "focal_length": -1.0,
    "parent_id": -1, "obj_id": -1, "img_id": -1,
}
LENGTHS = {"hue_hist": HUES, "global_hue_hist": HUES, "luma_hist": LUMAS, "scene_vector": SCENES}


def fields(struct: str) -> list[tuple[str, str]]:
    """Names and types of a struct's fields, in order."""
    out, depth, start = [], 0, 0
    body = struct[len("struct<") : -1]
    for i, c in enumerate(body + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = body[start:i].partition(":")
            out.append((name, kind))
            start = i + 1
    return out


def _default(name: str, kind: str) -> Column:
    if name in DEFAULTS:
        return F.lit(DEFAULTS[name]).cast(kind)
    if kind.startswith("map"):
        return F.create_map().cast(kind)
    if kind.startswith("array"):
        zeros = F.array_repeat(F.lit(0.0).cast("float"), LENGTHS.get(name, 0))
        return zeros.cast(kind)
    return F.lit({"string": "", "boolean": False}.get(kind, 0)).cast(kind)


def filled(value: Column, struct: str, **known: Column) -> Column:
    """``value`` as the struct, every missing field replaced by its sentinel."""
    out = []
    for name, kind in fields(struct):
        if name in known:
            out.append(known[name].cast(kind).alias(name))
        elif kind.startswith("struct"):
            out.append(filled(value[name], kind).alias(name))
        else:
            out.append(F.coalesce(value[name].cast(kind), _default(name, kind)).alias(name))
    return F.struct(*out)


def empty(struct: str, **known: Column) -> Column:
    """The struct with sentinels, but for the fields given."""
    return filled(F.lit(None).cast(struct), struct, **known)
