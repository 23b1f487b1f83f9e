"""One query per operator over the derived library, each with the same thing in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .functions import fuzzy as fz
from .operators import cluster, detect, embed, etl, runs, sets
from .session import Session
from .sources import derived, pieces, versions
from .sources import library as sources
from .sources.library import Library, Pack
from .storage import new_path
from .streaming import keyed, refresh

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The derived library in SQL: ``img`` (one row per image) and ``obj`` (one row per object).
PRELUDE = """
WITH img AS (
  SELECT o_orderkey AS k, o_custkey AS c, 'img_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '.jpg' AS path,
    o_orderpriority AS priority, o_orderstatus AS status, CAST(2000 + o_orderkey % 8000 AS FLOAT) AS kelvin,
    CAST((o_orderkey % 100) / 100.0 AS FLOAT) AS sat, CAST((o_orderkey * 7 % 100) / 100.0 AS FLOAT) AS val,
    ['red', 'blue', 'gray', 'brown'][CAST(o_orderkey % 4 + 1 AS INT)] AS colour,
    CAST((o_orderkey % 11) / 10.0 AS FLOAT) AS over_, CAST((o_orderkey % 13) / CAST(13 AS DOUBLE) AS FLOAT) AS under_,
    CAST(1 - (o_orderkey % 5) / 10.0 AS FLOAT) AS good, CAST((o_orderkey % 9) / CAST(9 AS DOUBLE) AS FLOAT) AS blur,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Acme' ELSE '' END AS make, CASE WHEN o_orderkey % 2 = 0 THEN 'M1' ELSE '' END AS model,
    CAST(100 * (o_orderkey % 32) AS DOUBLE) AS iso, CAST(CAST(1 / CAST(1 + o_orderkey % 500 AS DOUBLE) AS FLOAT) AS DOUBLE) AS shutter,
    CAST(1 + o_orderkey % 20 AS DOUBLE) AS aperture, CAST(20 + o_orderkey % 80 AS DOUBLE) AS focal,
    strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS taken, 'scene-' || CAST(o_orderkey % 7 AS VARCHAR) AS scene,
    CAST((o_orderkey % 21) / CAST(20 AS DOUBLE) AS FLOAT) AS indoor
  FROM orders),
obj AS (
  SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS pos,
    lower(p_type) AS class,
    CASE WHEN lower(p_type) IN ('economy', 'standard') THEN 'basic' WHEN lower(p_type) IN ('small', 'medium', 'large') THEN 'sized' ELSE 'root' END AS super,
    CAST(l_partkey % 1000 AS DOUBLE) / 1000 AS x, CAST(l_suppkey * 7 % 100 AS DOUBLE) / 100 AS y,
    l_quantity / 100 AS w, CAST(l_linenumber AS DOUBLE) / 14 AS h, l_quantity / 100 * (CAST(l_linenumber AS DOUBLE) / 14) AS area,
    1 - 5 * l_discount AS conf, CAST(l_partkey % 360 AS FLOAT) AS hue, CAST((l_partkey % 100) / 100.0 AS FLOAT) AS sat,
    CAST((l_partkey * 7 % 100) / 100.0 AS FLOAT) AS val, CAST(2000 + l_partkey * 13 % 8000 AS FLOAT) AS kelvin,
    ['red', 'blue', 'gray', 'brown'][CAST(l_partkey % 4 + 1 AS INT)] AS colour, CAST((l_partkey % 10) / 10.0 AS FLOAT) AS lbp,
    CAST((l_partkey % 7) / CAST(7 AS DOUBLE) AS FLOAT) AS blur
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def sig(z: str, k: int = 10) -> str:
    return f"CAST(1 / (1 + exp(-{k} * ({z}))) AS FLOAT)"


def is_class(name: str, factor: str = "0.8") -> str:
    return f"CAST(CASE WHEN class = '{name}' THEN conf WHEN super = '{name}' THEN conf * CAST({factor} AS DOUBLE) ELSE 0 END AS FLOAT)"


def clamp(x: str) -> str:
    return f"greatest(least(CAST({x} AS FLOAT), CAST(1 AS FLOAT)), CAST(0 AS FLOAT))"


def kelvin(low: int, span: int, flip: bool) -> str:
    share = f"(kelvin - CAST({low} AS FLOAT)) / CAST({span} AS FLOAT)"
    return clamp(f"1 - {share}" if flip else share)


def colour(name: str, hist: str) -> str:
    """Membership in a colour over the derived histograms: bins are (key + i * i) % 17 / ``hist``."""
    band = {n: [(int(d / 11.25 + 0.5) + j) % 32 for j in range(-2, 3)] for n, d in fz.HUES.items()}
    if name in band:
        rest = clamp(" + ".join(f"CAST((key + {i * i}) % 17 / CAST({hist} AS DOUBLE) AS FLOAT)" for i in band[name]))
    else:
        rest = {"gray": "CASE WHEN sat < 0.15 AND val > 0.15 AND val < 0.85 THEN 1 ELSE 0 END", "white": "CASE WHEN sat < 0.15 AND val > 0.85 THEN 1 ELSE 0 END", "black": "CASE WHEN val < 0.15 THEN 1 ELSE 0 END"}.get(name, "0")
    return f"CAST(CASE WHEN colour = '{name}' THEN 1 ELSE {rest} END AS FLOAT)"


def images(s: str) -> str:
    """SQL of a filter by an image-level score."""
    return f"{PRELUDE} SELECT path, round(CAST(s AS DOUBLE), 6) AS score FROM (SELECT *, k AS key, {s} AS s FROM (SELECT *, k AS key FROM img)) WHERE s > 0"


def any_(s: str, least: str = "s > 0") -> str:
    """SQL of a filter by the best object."""
    return f"{PRELUDE} SELECT path, round(CAST(s AS DOUBLE), 6) AS score FROM (SELECT path, max({s}) AS s FROM img JOIN (SELECT *, p AS key FROM obj) USING (k) GROUP BY path) WHERE {least}"


def all_(s: str, least: str = "s > 0") -> str:
    return f"{PRELUDE} SELECT path, round(CAST(s AS DOUBLE), 6) AS score FROM (SELECT path, coalesce(min({s}), CAST(1 AS FLOAT)) AS s FROM img LEFT JOIN obj USING (k) GROUP BY path) WHERE {least}"


def counted(s: str, of: str) -> str:
    """SQL of a filter by a count ``n`` of objects that ``of`` fits."""
    return f"{PRELUDE} SELECT path, round(CAST(s AS DOUBLE), 6) AS score FROM (SELECT path, {s} AS s FROM (SELECT path, CAST(count(CASE WHEN {of} THEN 1 END) AS DOUBLE) AS n FROM img LEFT JOIN obj USING (k) GROUP BY path)) WHERE s > 0"


def plain(df: DataFrame) -> DataFrame:
    """Scores and values to six places."""
    out = []
    for c, t in df.dtypes:
        out.append(F.round(F.col(c).cast("double"), 6).alias(c) if t in ("float", "double") else F.col(c))
    return df.select(*out)


def dsl(name: str, text: str, sql: str, **options) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(Session(derived.library(spark, sf_dir), **options).run(text).table())

    QUERIES[name], SQL[name] = query, sql


def frame(name: str, f, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
    if sql:
        SQL[name] = sql


PROMO = is_class("promo")
HAS_PROMO = f"SELECT path, max({PROMO}) AS score FROM img JOIN obj USING (k) GROUP BY path HAVING max({PROMO}) > 0"
HAS_SMALL = f"SELECT path, max({is_class('small')}) AS score FROM img JOIN obj USING (k) GROUP BY path HAVING max({is_class('small')}) > 0"
R6 = "round(CAST(score AS DOUBLE), 6) AS score"

# sources
dsl("src1_library", "$", f"{PRELUDE} SELECT path, CAST(1 AS DOUBLE) AS score FROM img")
dsl("src2_current_image", "$ : ($ any promo)", f"{PRELUDE} SELECT path, CAST(1 AS DOUBLE) AS score FROM ({HAS_PROMO})")
dsl("src3_collection", 'collection("tens")', f"{PRELUDE} SELECT path, CAST(1 AS DOUBLE) AS score FROM img WHERE k % 10 = 0")
dsl("src4_object_collection", '$ : (obj any (class == "promo"))', any_(PROMO))
dsl("src1_tag_prefilter", "$", f"{PRELUDE} SELECT path, CAST(1 AS DOUBLE) AS score FROM img WHERE priority IN ('1-URGENT', '2-HIGH') AND status = 'F'", tags=["priority=1-URGENT|2-HIGH", "status=F"])
frame("src15_cluster_source", lambda s, d: cluster.cluster_members(_lots(s, d), "lot", "lot_3"), f"{PRELUDE} SELECT DISTINCT path, CAST(1 AS DOUBLE) AS score FROM img JOIN obj USING (k) WHERE p % 5 = 3")

# filters and quantifiers
dsl("flt1_filter_any", '$ : (any(class == "promo"))', any_(PROMO))
dsl("flt2_any", "$ any (area > 0.2)", any_(sig("area - 0.2")))
dsl("flt3_all", "$ all (area > 0.05)", all_(sig("area - 0.05")))
dsl("flt4_objects_any", "(% $) any (area > 0.3)", f"{PRELUDE} SELECT round(CAST(max({sig('area - 0.3')}) AS DOUBLE), 6) AS value FROM obj")
dsl("flt5_objects_all", "(% $) all (confidence > 0.4)", f"{PRELUDE} SELECT round(CAST(min({sig('conf - 0.4')}) AS DOUBLE), 6) AS value FROM obj")
dsl("flt6_functional_any", "$ : (any(w > 0.4))", any_(sig("w - 0.4")))
dsl("flt7_functional_all", "$ : (all(w > 0.1))", all_(sig("w - 0.1")))
dsl("flt8_implicit_any", "$ (h < 0.2)", any_(sig("0.2 - h")))
dsl("flt9_shorthand", "$ any sized", any_(is_class("sized")))
dsl("flt10_hard", "$ : (any(area > 0.2) && img_bright() > 0.5)", f"{PRELUDE} SELECT path, {R6} FROM (SELECT path, least(max({sig('area - 0.2')}), {sig('CAST(any_value(val) AS DOUBLE) - 0.5')}) AS score FROM img JOIN (SELECT k, area FROM obj) USING (k) GROUP BY path) WHERE score >= 0.5", hard=True)
frame("flt12_tag_keys", lambda s, d: catalog.tag_keys(derived.library(s, d).images), "SELECT * FROM (VALUES ('priority'), ('status')) t(key)")

# comparison, logic, arithmetic
dsl("cmp1_greater", "$ : (img_aperture() > 10)", images(sig("aperture - 10")))
dsl("cmp2_less", "$ : (img_aperture() <= 10)", images(sig("10 - aperture")))
dsl("cmp3_equal_place", "$ : (any(x == 0.5))", any_("CAST(exp(-((x - 0.5) * (x - 0.5)) / (2 * 0.05 * 0.05)) AS FLOAT)"))
dsl("cmp3_equal_other", "$ : (img_fl() == 50)", images("CAST(exp(-((focal - 50) * (focal - 50)) / (2 * 0.1 * 0.1)) AS FLOAT)"))
dsl("cmp4_unequal", "$ : (any(y != 0.5))", any_("CAST(1 - exp(-((y - 0.5) * (y - 0.5)) / (2 * 0.05 * 0.05)) AS FLOAT)"))
dsl("cmp5_count_equal", "$ : (cnt(sized) == 2)", counted("CASE WHEN greatest(n, 2) <= 0 THEN CAST(1 AS FLOAT) ELSE " + clamp("1 - abs(n - 2) / greatest(n, 2)") + " END", "super = 'sized'"))
dsl("cmp6_count_more", "$ : (cnt(goods) > 1)", counted(sig("n - 2.5"), "class <> 'promo'"))
dsl("cmp7_class", '$ : (any(class == "basic"))', any_(is_class("basic")))
dsl("cmp8_super_class", '$ : (any(super_class == "sized"))', any_("CAST(CASE WHEN super = 'sized' THEN conf * CAST(0.8 AS DOUBLE) ELSE 0 END AS FLOAT)"))
dsl("cmp9_class_unequal", '$ : (all(class != "promo"))', all_(f"CAST(1 AS FLOAT) - {PROMO}"))
dsl("cmp10_text", '$ : (img_scene_top() == "scene-3")', images("CAST(CASE WHEN scene = 'scene-3' THEN 1 ELSE 0 END AS FLOAT)"))
dsl("log1_and_or", "$ : (any(area > 0.2) && any(promo) || img_bright())", f"{PRELUDE} SELECT path, {R6} FROM (SELECT path, greatest(least(max({sig('area - 0.2')}), max({PROMO})), {clamp('any_value(val)')}) AS score FROM img JOIN (SELECT k, area, class, super, conf FROM obj) USING (k) GROUP BY path UNION ALL SELECT path, {clamp('val')} FROM img WHERE k NOT IN (SELECT k FROM obj)) WHERE score > 0")
dsl("log2_not", "$ : (!img_bright())", images(f"CAST(1 AS FLOAT) - {clamp('val')}"))
dsl("log3_score_alias", "$ : (img_bright() & img_colorful())", images(f"least({clamp('val')}, {clamp('sat * 2')})"))
dsl("ari1_arithmetic", "$ : (img_iso() / 100 - img_aperture() * 2 + 1 > 0)", images(sig("iso / 100 - aperture * 2 + 1")))
dsl("ari3_negate", "$ : (-img_aperture() > -5)", images(sig("-aperture + 5")))
dsl("cls1_bare_class", "$ : (basic)", any_(is_class("basic", "0.800000011920929")))

# projections, joins, sets
dsl("prj5_to_images", "^ % $", f"{PRELUDE} SELECT path, {R6} FROM (SELECT path, max(CAST(conf AS FLOAT)) AS score FROM img JOIN obj USING (k) GROUP BY path)")
frame("prj4_to_objects", lambda s, d: _objects(Session(derived.library(s, d)).run("% ($ any promo)").objects()), f"{PRELUDE} SELECT path AS image_path, class, round(x, 6) AS x, round(y, 6) AS y, round(CAST(CAST(conf AS FLOAT) AS DOUBLE), 6) AS score FROM img JOIN obj USING (k) WHERE path IN (SELECT path FROM ({HAS_PROMO}))")
dsl("set1_union", "($ any promo) | ($ any small)", f"{PRELUDE} SELECT path, round(CAST(max(score) AS DOUBLE), 6) AS score FROM ({HAS_PROMO} UNION ALL {HAS_SMALL}) GROUP BY path")
dsl("set2_intersect", "($ any promo) & ($ any small)", f"{PRELUDE}, a AS ({HAS_PROMO}), b AS ({HAS_SMALL}) SELECT path, round(CAST(least(a.score, b.score) AS DOUBLE), 6) AS score FROM a JOIN b USING (path)")
dsl("set3_subtract", "($ any promo) - ($ any small)", f"{PRELUDE}, a AS ({HAS_PROMO}), b AS ({HAS_SMALL}) SELECT path, {R6} FROM a WHERE path NOT IN (SELECT path FROM b)")
_KEY = "path || ':' || class || ':' || printf('%.6f', x) || ':' || printf('%.6f', y)"
_BAG = f"SELECT path AS image_path, class, round(x, 6) AS x, round(y, 6) AS y, round(CAST(CAST(conf AS FLOAT) AS DOUBLE), 6) AS score, {_KEY} AS key FROM img JOIN obj USING (k)"
_PAIR = f"{PRELUDE}, a AS ({_BAG} WHERE path IN (SELECT path FROM ({HAS_PROMO}))), b AS ({_BAG} WHERE path IN (SELECT path FROM ({HAS_SMALL})))"
frame("set5_objects_intersect", lambda s, d: _objects(Session(derived.library(s, d)).run("(% ($ any promo)) & (% ($ any small))").objects()), f"{_PAIR} SELECT image_path, class, x, y, score FROM a WHERE key IN (SELECT key FROM b)")
frame("set6_objects_subtract", lambda s, d: _objects(Session(derived.library(s, d)).run("(% ($ any promo)) - (% ($ any small))").objects()), f"{_PAIR} SELECT image_path, class, x, y, score FROM a WHERE key NOT IN (SELECT key FROM b)")
frame("set4_objects_union", lambda s, d: _objects(Session(derived.library(s, d)).run("(% ($ any promo)) | (% ($ any small))").objects()).select("image_path", "class", "x", "y"), f"{_PAIR} SELECT image_path, class, x, y FROM a UNION ALL SELECT DISTINCT ON (key) image_path, class, x, y FROM b WHERE key NOT IN (SELECT key FROM a)")
_TWO = "SELECT a.k AS k, least({m}, {n}, {r}) AS s FROM obj a JOIN obj b ON a.k = b.k AND a.pos <> b.pos"


def _pairs(one: str, two: str, relation: str) -> str:
    side = lambda t, n: is_class(n, "0.800000011920929").replace("class", f"{t}.class").replace("super", f"{t}.super").replace("conf", f"{t}.conf")
    return f"{PRELUDE} SELECT path, {R6} FROM (SELECT path, max(s) AS score FROM img JOIN ({_TWO.format(m=side('a', one), n=side('b', two), r=relation)}) USING (k) GROUP BY path) WHERE score > 0"


_OVERLAP = "least(a.{c} + a.{d} / 2, b.{c} + b.{d} / 2) - greatest(a.{c} - a.{d} / 2, b.{c} - b.{d} / 2)"
_W, _H = _OVERLAP.format(c="x", d="w"), _OVERLAP.format(c="y", d="h")
dsl("joi1_left_of", "$ : (left_of(promo, sized))", _pairs("promo", "sized", sig("b.x - (a.x + a.w)", 20)))
dsl("joi2_above", "$ : (above(promo, basic))", _pairs("promo", "basic", sig("b.y - (a.y + a.h)", 20)))
dsl("joi3_inside", "$ : (inside(promo, sized))", _pairs("promo", "sized", f"CAST(CASE WHEN {_W} > 0 AND {_H} > 0 THEN ({_W}) * ({_H}) / (a.w * a.h) ELSE 0 END AS FLOAT)"))

# aggregates
dsl("agg1_count", "$ : (cnt(goods) >= 3)", counted(sig("n - 3"), "class <> 'promo'"))
dsl("agg2_count_of_objects", "(% ($ any promo)) any (cnt(sized) > 3)", f"{PRELUDE} SELECT round(CAST({sig('n - 2.5')} AS DOUBLE), 6) AS value FROM (SELECT CAST(count(CASE WHEN super = 'sized' THEN 1 END) AS DOUBLE) AS n FROM img JOIN obj USING (k) WHERE path IN (SELECT path FROM ({HAS_PROMO})))")
dsl("agg3_count_all", "cnt(goods)", f"{PRELUDE} SELECT CAST(count(*) AS DOUBLE) AS value FROM obj WHERE class <> 'promo'")
dsl("agg10_scene_max", "$ : (img_scene_vec())", images("CAST(list_max(list_transform(range(17), lambda j: (k + j * j) % 17)) / CAST(1000 AS DOUBLE) AS FLOAT)"))
frame("agg8_indoor_sum", lambda s, d: derived.library(s, d).images.select("path", etl.indoor(F.col("img_attrs.scene_vector")).alias("score")), f"{PRELUDE} SELECT path, round(CAST(CAST(list_sum(list_transform(range(205), lambda i: CAST(CAST((k + i * i) % 17 / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE))) AS FLOAT) AS DOUBLE), 6) AS score FROM img")
frame("agg9_scene_argmax", lambda s, d: derived.library(s, d).images.select("path", (F.array_position("img_attrs.scene_vector", F.array_max("img_attrs.scene_vector")) - 1).cast("int").alias("at")), f"{PRELUDE} SELECT path, CAST(list_min(list_filter(range(365), lambda i: (k + i * i) % 17 = 16)) AS INT) AS at FROM img WHERE len(list_filter(range(365), lambda i: (k + i * i) % 17 = 16)) > 0 UNION ALL SELECT path, CAST(list_min(list_filter(range(365), lambda i: (k + i * i) % 17 = list_max(list_transform(range(17), lambda j: (k + j * j) % 17)))) AS INT) FROM img WHERE len(list_filter(range(365), lambda i: (k + i * i) % 17 = 16)) = 0")
frame("agg11_cluster_counts", lambda s, d: cluster.cluster_counts(_lots(s, d), "lot"), f"{PRELUDE} SELECT 'lot_' || CAST(p % 5 AS VARCHAR) AS cluster_id, count(DISTINCT k) AS images FROM obj GROUP BY 1")
frame("agg14_next_ids", lambda s, d: etl.next_ids(derived.library(s, d).images), f"{PRELUDE} SELECT (SELECT max(k) + 1 FROM img) AS next_img_id, (SELECT max(k * 1000 + pos) + 1 FROM obj) AS next_obj_id")

# order
frame("srt1_engine_order", lambda s, d: _positions(Session(derived.library(s, d)), False), f"{PRELUDE} SELECT path, {R6}, row_number() OVER (ORDER BY score, path) AS place FROM ({HAS_PROMO}) WHERE score >= 0")
frame("srt2_best_first", lambda s, d: _positions(Session(derived.library(s, d)), True), f"{PRELUDE} SELECT path, {R6}, row_number() OVER (ORDER BY score DESC, path) AS place FROM ({HAS_PROMO}) WHERE score >= 0.05")

# numbers and texts
for _name, _text, _expr in (
    ("mth1_max", "max(img_aperture(), 10) > 12", "greatest(aperture, 10) - 12"),
    ("mth2_min", "min(img_aperture(), 10) > 5", "least(aperture, 10) - 5"),
    ("mth3_abs", "abs(img_aperture() - 10) > 3", "abs(aperture - 10) - 3"),
    ("mth4_sqrt", "sqrt(img_fl()) > 7", "sqrt(focal) - 7"),
    ("mth5_pow", "pow(img_aperture(), 2) > 99", "pow(aperture, 2) - 99"),
    ("mth6_log", "log(img_fl()) > 4", "ln(focal) - 4"),
    ("mth7_exp", "exp(img_aperture() / 10) > 3", "exp(aperture / 10) - 3"),
    ("str1_stof", 'stof("12.5mm") < img_aperture()', "aperture - 12.5"),
    ("img8_iso", "img_iso() > 1600", "(iso - 1600) / 1"),
    ("img9_shutter", "img_shutter() > 0.25", "shutter - 0.25"),
    ("img11_focal", "img_fl() < 30", "30 - focal"),
):
    dsl(_name, f"$ : ({_text})", images(sig(f"greatest(least({_expr}, 70), -70)")))
_IS = "CAST(CASE WHEN {} THEN 1 ELSE 0 END AS FLOAT)".format
for _name, _text, _expr in (
    ("str2_contains", 'str_contains(img_scene_top(), "-3")', _IS("contains(scene, '-3')")),
    ("map1_tag", 'img_tag("priority") == "5-LOW"', _IS("priority = '5-LOW'")),
    ("map2_has_tag", 'img_has_tag("status")', "CAST(1 AS FLOAT)"),
    ("map3_tag_equals", 'img_tag_equals("status", "P")', _IS("status = 'P'")),
    ("dat1_date", 'str_contains(img_date(), "1995:0")', _IS("contains(taken, '1995:0')")),
    ("img7_camera", 'img_camera() == "Acme M1"', _IS("trim(make || ' ' || model) = 'Acme M1'")),
    ("scn2_scene_top", 'img_scene_top() != "scene-1"', _IS("scene <> 'scene-1'")),
    ("col7_temp", "img_temp()", kelvin(2000, 8000, False)),
    ("col8_warmth", "img_warmth()", kelvin(2000, 6000, True)),
    ("col9_coolness", "img_coolness()", kelvin(2000, 6000, False)),
    ("col10_img_color_red", 'img_color("red")', colour("red", "200")),
    ("col10_img_color_pink", 'img_color("pink")', colour("pink", "200")),
    ("col10_img_color_gray", 'img_color("gray")', colour("gray", "200")),
    ("col11_bright", "img_bright()", clamp("val")),
    ("col12_colorful", "img_colorful()", clamp("sat * 2")),
    ("img1_over", "img_over()", "over_"),
    ("img2_under", "img_under()", "under_"),
    ("img3_exposure", "img_exp_good()", "good"),
    ("img4_blur", "img_blur()", "blur"),
    ("img5_blurry", "img_blurry()", clamp("1 - blur")),
    ("scn4_indoor", "img_is_indoor()", clamp("indoor")),
    ("his5_img_bin", "img_hist_value(3)", "CAST((k + 9) % 17 / CAST(200 AS DOUBLE) AS FLOAT)"),
    ("his6_luma_bin", "img_hist_val(40)", "CAST((k + 1600) % 17 / CAST(400 AS DOUBLE) AS FLOAT)"),
    ("scn1_scene_label", 'img_scene("place 15")', "CAST((k + 225) % 17 / CAST(1000 AS DOUBLE) AS FLOAT)"),
    ("scn1_scene_index", 'img_scene("123")', "CAST((k + 15129) % 17 / CAST(1000 AS DOUBLE) AS FLOAT)"),
):
    dsl(_name, f"$ : ({_text})", images(_expr))
_H1 = "list_transform(range(32), lambda i: CAST(CAST((k + i * i) % 17 / CAST(200 AS DOUBLE) AS FLOAT) AS DOUBLE))"
_H2 = "list_transform(range(32), lambda i: CAST(CAST((p + i * i) % 17 / CAST(200 AS DOUBLE) AS FLOAT) AS DOUBLE))"
dsl("his3_hist_sim", "$ : (any(hist_sim(obj_hist(obj), img_hist())))", any_(clamp(f"list_dot_product({_H1}, {_H2}) / (sqrt(list_dot_product({_H1}, {_H1})) * sqrt(list_dot_product({_H2}, {_H2})))")))

# objects
for _name, _text, _expr in (
    ("col1_color", 'color(obj, "red")', colour("red", "200")),
    ("col1_color_white", 'color("white")', colour("white", "200")),
    ("col2_cct", "cct(obj)", kelvin(2000, 8000, False)),
    ("col3_warmth", "warmth(obj)", kelvin(2000, 6000, True)),
    ("col4_coolness", "coolness()", kelvin(2000, 6000, False)),
    ("col5_brightness", "brightness(obj)", clamp("val")),
    ("col6_saturation", "saturation(obj)", clamp("sat")),
    ("his4_bin", "hist_value(obj, 5)", "CAST((p + 25) % 17 / CAST(200 AS DOUBLE) AS FLOAT)"),
    ("img6_obj_blur", "obj_blur(obj)", "blur"),
    ("clu1_cluster_id", 'cluster_id(obj, "lot") == "lot_2"', _IS("p % 5 = 2")),
    ("prj3_attr", "obj.attr.s > 0.5", sig("CAST(sat AS DOUBLE) - 0.5")),
    ("geo1_big", "big", sig("area - 0.2")),
    ("geo2_small", "small(obj)", sig("0.05 - area")),
    ("geo3_left", "left", sig("0.33 - (x + w / 2)")),
    ("geo4_right", "right", sig("x + w / 2 - 0.67")),
    ("geo5_top", "top", sig("0.33 - (y + h / 2)")),
    ("geo6_bottom", "bottom", sig("y + h / 2 - 0.67")),
    ("geo7_square", "square", sig("0.1 - abs(w / h - 1)")),
    ("atm1_warm", "warm", f"least({sig('greatest(least(CAST(hue AS DOUBLE) - 5, 70), -70)')}, {sig('greatest(least(45 - CAST(hue AS DOUBLE), 70), -70)')})"),
    ("atm2_cool", "cool", f"least({sig('greatest(least(CAST(hue AS DOUBLE) - 180, 70), -70)')}, {sig('greatest(least(260 - CAST(hue AS DOUBLE), 70), -70)')})"),
    ("atm3_bright", "bright", sig("CAST(val AS DOUBLE) - 0.75")),
    ("atm4_dark", "dark", sig("0.25 - CAST(val AS DOUBLE)")),
    ("atm5_smooth", "smooth", sig("0.2 - CAST(lbp AS DOUBLE)")),
    ("atm6_rough", "rough", sig("CAST(lbp AS DOUBLE) - 0.6")),
):
    dsl(_name, f"$ : (any({_text}))", any_(_expr.replace("blur", "obj_.blur").replace("val", "obj_.val").replace("sat", "obj_.sat").replace("kelvin", "obj_.kelvin").replace("colour", "obj_.colour")).replace("(SELECT *, p AS key FROM obj) USING (k)", "(SELECT *, p AS key FROM obj) obj_ USING (k)"))
dsl("udf1_macro", "macro wide(o, t) = o.w > t; $ : (any(wide(obj, 0.4)))", any_(sig("w - 0.4")))
dsl("udf3_dynamic_scope", "macro over(o) = o.w > t; macro set(t) = any(over(obj)); $ : (set(0.3))", any_(sig("w - 0.3")))
dsl("udf4_variables", "p = $ any promo; s = $ any small; out = p & s; $", SQL["set2_intersect"])
_BEST = "SELECT k, p % 5 AS lot FROM obj WHERE class = 'promo' AND CAST(conf AS FLOAT) > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY CAST(conf AS FLOAT) DESC, pos) = 1"
dsl("agg6_best_of_class", '$ : (cluster_id(promo, "lot") == "lot_2")', f"{PRELUDE} SELECT path, 1.0 AS score FROM img JOIN ({_BEST}) b USING (k) WHERE lot = 2")
dsl("clu2_cluster_sim", '$ all (cluster_sim(obj, promo, "lot"))', f"{PRELUDE} SELECT path, 1.0 AS score FROM img JOIN ({_BEST}) b USING (k) JOIN obj o USING (k) GROUP BY path HAVING bool_and(o.p % 5 = b.lot) UNION ALL SELECT path, 1.0 FROM img WHERE k NOT IN (SELECT k FROM obj)")
dsl("rel1_left_of_objects", "best = 1; $ : (any(left_of(obj, obj)))", any_(sig("x - (x + w)")))


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived images, grouped by the lots of their objects."""
    i = derived.library(spark, sf_dir).images
    ids = F.array_sort(F.array_distinct(F.transform("objects", lambda o: o["cluster_ids"]["lot"])))
    return i.withColumn("img_attrs", F.col("img_attrs").withField("cluster_groups", F.create_map(F.lit("lot"), ids)))


def _objects(df: DataFrame) -> DataFrame:
    return df.select("image_path", F.col("o.class").alias("class"), F.col("o.x").alias("x"), F.col("o.y").alias("y"), "score")


def _positions(session: Session, best: bool) -> DataFrame:
    """All images with a promo object, with their places."""
    kept = session.run("$ any promo").table().where(F.col("score") >= (0.05 if best else 0.0))
    return sets.numbered(kept, F.desc("score") if best else F.asc("score"), F.asc("path"), tasks=session.library.tasks)


# keeping libraries
def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    old = o.where("o_orderkey % 7 <> 0").select(derived.path(F.col("o_orderkey")).alias("path"), F.lit(1).cast("long").alias("mtime"), (F.col("o_custkey") % 3).alias("size"))
    new = o.where("o_orderkey % 5 <> 0").select(derived.path(F.col("o_orderkey")).alias("path"), F.when(F.col("o_orderkey") % 11 == 0, 2).otherwise(1).cast("long").alias("mtime"), (F.col("o_custkey") % 3 + F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(0)).alias("size"))
    return old, new


frame("etl1_changes", lambda s, d: etl.changes(*_listings(s, d)), f"""{PRELUDE} SELECT path, CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 5 = 0 THEN 'deleted'
  WHEN k % 11 = 0 OR (c % 3 <> 0 AND k % 13 = 0) THEN 'modified' ELSE 'same' END AS change FROM img WHERE k % 7 <> 0 OR k % 5 <> 0""")
frame("etl2_stable_ids", lambda s, d: etl.with_ids(derived.library(s, d).images.select("path", "img_id"), derived.library(s, d).images.where("img_id % 4 <> 0").select("path", "img_id"), 10_000_000),
      f"{PRELUDE} SELECT path, CASE WHEN k % 4 <> 0 THEN k ELSE 10000000 + row_number() OVER (PARTITION BY k % 4 = 0 ORDER BY path) - 1 END AS img_id FROM img")
frame("etl9_fallback", lambda s, d: derived.library(s, d).images.select(F.explode(F.transform("objects", lambda o: etl.fallback(o, derived.library(s, d), 0.7))).alias("o")).groupBy(F.col("o.class").alias("class"), F.col("o.super_class").alias("super_class"), F.col("o.original_class").alias("original_class"), F.col("o.is_fallback").alias("is_fallback")).agg(F.count(F.lit(1)).alias("n")),
      f"""{PRELUDE} SELECT CASE WHEN f THEN super ELSE class END AS class, super AS super_class, CASE WHEN f THEN class ELSE '' END AS original_class, f AS is_fallback, count(*) AS n
  FROM (SELECT *, conf < 0.7 AND super <> 'root' AS f FROM obj) GROUP BY ALL""")  # fmt: skip
frame("snk11_batch_tag", lambda s, d: catalog.set_tag(derived.library(s, d).images, Session(derived.library(s, d)).run('collection("urgent")').table(), "seen", "yes").select("path", F.coalesce(F.try_element_at("img_attrs.user_tags", F.lit("seen")), F.lit("")).alias("seen"), F.try_element_at("img_attrs.user_tags", F.lit("status")).alias("status")), f"{PRELUDE} SELECT path, CASE WHEN priority = '1-URGENT' THEN 'yes' ELSE '' END AS seen, status FROM img")
frame("snk12_rename", lambda s, d: catalog.new_names(derived.library(s, d).images, "{date}_{scene}"), f"""{PRELUDE}, n AS (SELECT path AS old, replace(substr(taken, 1, 10), ':', '') || '_' || scene || '.jpg' AS new FROM img)
  SELECT old, new, row_number() OVER (PARTITION BY new ORDER BY old) > 1 AS conflict FROM n""")
frame("snk14_album_add", lambda s, d: catalog.add_to_album(derived.library(s, d).collections, "tens", Session(derived.library(s, d)).run('collection("urgent")').table()).groupBy("name").agg(F.countDistinct("path").alias("images")), f"{PRELUDE} SELECT 'tens' AS name, count(*) AS images FROM img WHERE k % 10 = 0 OR priority = '1-URGENT' UNION ALL SELECT 'urgent', count(*) FROM img WHERE priority = '1-URGENT'")
frame("snk15_display_names", lambda s, d: cluster.display_names(cluster.cluster_counts(_lots(s, d), "lot").select("cluster_id"), s.createDataFrame([("lot_1", "First")], "cluster_id string, display string"), "lot"), "SELECT * FROM (VALUES ('lot_0', '0'), ('lot_1', 'First'), ('lot_2', '2'), ('lot_3', '3'), ('lot_4', '4')) t(cluster_id, display)")
frame("snk10_report", lambda s, d: catalog.report(derived.library(s, d), Session(derived.library(s, d)).run("$ any promo").rows()).select("path", "score", "colour", "tags"), f"{PRELUDE} SELECT path, {R6}, colour, 'priority=' || priority || ', status=' || status AS tags FROM ({HAS_PROMO}) JOIN (SELECT path, colour, priority, status FROM img) USING (path) WHERE score >= 0.05")
frame("snk7_delete", lambda s, d: _deleted(s, d), f"{PRELUDE} SELECT path FROM img WHERE path NOT IN (SELECT path FROM ({HAS_PROMO}))")
frame("snk1_object_results", lambda s, d: Session(derived.library(s, d)).run("% ($ any promo)").ordered(), f"{PRELUDE} SELECT path, {R6} FROM (SELECT path, max(CAST(conf AS FLOAT)) AS score FROM img JOIN obj USING (k) WHERE path IN (SELECT path FROM ({HAS_PROMO})) GROUP BY path)")


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(derived.library(spark, sf_dir), allow_delete=True)
    s.run("del ($ any promo)")
    return s.library.images.select("path")


# clusters and streams
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


frame("joi11_similar", lambda s, d: cluster.similar(_vectors(s, d), 0.35).select("a", "b"), "SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.35")
frame("clu3_groups", lambda s, d: cluster.groups(_vectors(s, d), 0.4), """WITH RECURSIVE e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id AND list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.4),
  r(id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.node = e.a)
  SELECT id, min(node) AS comp FROM r GROUP BY id""")
frame("stm2_newest", lambda s, d: refresh.newest(s.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type"), "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
frame("stm3_deletes", lambda s, d: _state(s, d), "SELECT user_id, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("gone"))
    start = feed.where("event_id % 2 = 0").drop("gone").limit(0)
    return refresh.apply_changes(start, feed, "user_id", ["ts", "event_id"], "gone").select("user_id", "event_id")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of four batches, each of all times; keys whose last event is an error are deleted."""
    feed, at = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", (F.col("event_type") == "error").alias("gone")), new_path(spark, "feed")
    feed.withColumn("batch", F.col("event_id") % 4).repartition(4, "batch").write.partitionBy("batch").parquet(at)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(at)
    log = new_path(spark, "log")
    keyed.log(keyed.taking_effect(stream, "user_id", "ts", "event_id", "gone", keep=0, delay="36500 days"), log, new_path(spark, "checkpoint")).awaitTermination()
    return keyed.table(spark, log, "user_id", ["ts", "event_id"], "gone").select("user_id", "event_id", "event_type")


frame("stm2_keyed_state", _keyed, "SELECT user_id, event_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two changes on a base, read back as the last version and, for their paths, as the first."""
    images, folder = derived.library(spark, sf_dir).images, new_path(spark, "library")
    versions.replace(images.where("img_id % 3 <> 0"), folder, "base")
    versions.change(images.where("img_id % 5 = 0").withColumn("size", F.lit(-1).cast("long")), images.where("img_id % 7 = 0"), folder, "base", batch=0)
    versions.change(images.where("img_id % 11 = 0").withColumn("size", F.lit(-2).cast("long")), None, folder, "base", batch=1)
    versions.change(images.limit(0), images, folder, "base", batch=1)
    first = versions.read(spark, folder, "base", 0).select("path", F.lit(True).alias("was"))
    return versions.read(spark, folder, "base").join(first, "path", "left").select("path", "img_id", "size", F.size("objects").alias("objects"), F.coalesce("was", F.lit(False)).alias("was"))


frame("etl13_versions", _versions, f"""{PRELUDE} SELECT path, k AS img_id, CASE WHEN k % 11 = 0 THEN -2 WHEN k % 5 = 0 THEN -1 ELSE c END AS size, CAST(count(p) AS INT) AS objects, k % 3 <> 0 AS was
  FROM img LEFT JOIN obj USING (k) WHERE k % 11 = 0 OR k % 5 = 0 OR (k % 3 <> 0 AND k % 7 <> 0) GROUP BY path, k, c""")



# detections and runs
def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as anchors of a 640 wide input; the pictures are 1300 by 650."""
    k, d = F.col("l_partkey"), lambda c: c.cast("double")
    score = F.array(*[d(k * m % 101) / 100 for m in (3, 7, 11)])
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("picture"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), d(k % 640).alias("cx"), d(F.col("l_orderkey") % 640).alias("cy"), F.col("l_quantity").cast("double").alias("w"),
        d(F.col("l_linenumber") * 20).alias("h"), score.alias("scores"), F.lit(0.5).alias("scale"), F.lit(0).alias("left"), F.lit(160).alias("top"), F.lit(1300).alias("width"), F.lit(650).alias("height"),
    )


_ANCHORS = """a AS (SELECT l_suppkey AS picture, l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey % 640 AS DOUBLE) AS cx, CAST(l_orderkey % 640 AS DOUBLE) AS cy, CAST(l_quantity AS DOUBLE) AS w,
    CAST(l_linenumber * 20 AS DOUBLE) AS h, [CAST(l_partkey * 3 % 101 AS DOUBLE) / 100, CAST(l_partkey * 7 % 101 AS DOUBLE) / 100, CAST(l_partkey * 11 % 101 AS DOUBLE) / 100] AS s FROM lineitem),
  c AS (SELECT picture, id, list_max(s) AS confidence, CAST(list_position(s, list_max(s)) - 1 AS INT) AS k, greatest(0, least(1300, (cx - w / 2) / 0.5)) AS x1, greatest(0, least(1300, (cx + w / 2) / 0.5)) AS x2,
    greatest(0, least(650, (cy - h / 2 - 160) / 0.5)) AS y1, greatest(0, least(650, (cy + h / 2 - 160) / 0.5)) AS y2 FROM a WHERE list_max(s) >= 0.7),
  b AS MATERIALIZED (SELECT picture, id, k, confidence, (x1 + x2) / 2 / 1300 AS x, (y1 + y2) / 2 / 650 AS y, (x2 - x1) / 1300 AS w, (y2 - y1) / 650 AS h FROM c WHERE x2 > x1 AND y2 > y1)"""
frame("etl7_decode", lambda s, d: detect.decoded(_anchors(s, d), 0.7), f"WITH {_ANCHORS} SELECT picture, id, k, round(confidence, 6) AS confidence, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM b")
frame("etl8_suppress", lambda s, d: detect.suppressed(detect.decoded(_anchors(s, d), 0.7), 0.3, ["picture", "k"], [F.col("id"), F.col("x"), F.col("w")]).select("picture", "k", "id"), f"""WITH RECURSIVE {_ANCHORS},
  o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY picture, k ORDER BY w * h DESC, id, x, w) AS n FROM b),
  r(picture, k, n, kept) AS (SELECT picture, k, n, [{{'id': id, 'x': x, 'y': y, 'w': w, 'h': h}}] FROM o WHERE n = 1 UNION ALL
    SELECT o.picture, o.k, o.n, CASE WHEN len(list_filter(kept, lambda t: least(t.x + t.w / 2, o.x + o.w / 2) > greatest(t.x - t.w / 2, o.x - o.w / 2) AND least(t.y + t.h / 2, o.y + o.h / 2) > greatest(t.y - t.h / 2, o.y - o.h / 2)
      AND (least(t.x + t.w / 2, o.x + o.w / 2) - greatest(t.x - t.w / 2, o.x - o.w / 2)) * (least(t.y + t.h / 2, o.y + o.h / 2) - greatest(t.y - t.h / 2, o.y - o.h / 2)) / (t.w * t.h + o.w * o.h
        - (least(t.x + t.w / 2, o.x + o.w / 2) - greatest(t.x - t.w / 2, o.x - o.w / 2)) * (least(t.y + t.h / 2, o.y + o.h / 2) - greatest(t.y - t.h / 2, o.y - o.h / 2))) > 0.3)) > 0
      THEN kept ELSE list_append(kept, {{'id': o.id, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}}) END FROM r JOIN o ON o.picture = r.picture AND o.k = r.k AND o.n = r.n + 1)
  SELECT picture, k, unnest(kept).id AS id FROM r QUALIFY n = max(n) OVER (PARTITION BY picture, k)""")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five listings of the orders, each compared with the one before; two of them show nothing new."""
    orders, folder = spark.read.parquet(f"{sf_dir}/orders.parquet"), new_path(spark, "runs")
    key = F.col("o_orderkey")
    lists = [orders.where(key % 10 < most).select(derived.path(key).alias("path"), F.when(key % 7 == touched, 2).otherwise(1).cast("long").alias("mtime"), F.lit(1).cast("long").alias("size")) for most, touched in ((5, -1), (5, -1), (7, -1), (7, -1), (6, 3))]
    for i, new in enumerate(lists):
        change, seen = runs.observed(lists[i - 1] if i else new.limit(0), new)
        change.write.format("noop").mode("overwrite").save()
        runs.record(spark, folder, i, seen)
    return runs.history(spark, folder)


_LISTED = "l AS (SELECT 0 AS run, 5 AS most, -1 AS touched UNION ALL VALUES (1, 5, -1), (2, 7, -1), (3, 7, -1), (4, 6, 3)), f AS (SELECT run, o_orderkey, CASE WHEN o_orderkey % 7 = touched THEN 2 ELSE 1 END AS mtime FROM orders JOIN l ON o_orderkey % 10 < most)"
_RUNS_SQL = f"""WITH {_LISTED}, n AS (SELECT coalesce(f.run, g.run + 1) AS run, CASE WHEN f.run IS NULL THEN 'deleted' WHEN g.run IS NULL THEN 'added' WHEN f.mtime <> g.mtime THEN 'modified' ELSE 'same' END AS change
    FROM f FULL JOIN f g ON f.o_orderkey = g.o_orderkey AND f.run = g.run + 1 WHERE coalesce(f.run, g.run + 1) <= 4),
  runs AS (SELECT run, count(*) FILTER (change <> 'deleted') AS files, count(*) FILTER (change IN ('added', 'modified')) AS changed, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change <> 'same') = 0 AS hit FROM n GROUP BY run)"""
frame("agg15_runs", _runs, f"{_RUNS_SQL} SELECT CAST(run AS BIGINT) AS run, files, changed, deleted, hit FROM runs")
frame("agg15_hit_ratio", lambda s, d: runs.hit_ratio(_runs(s, d)), f"{_RUNS_SQL} SELECT count(*) AS runs, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM runs")



# embeddings
def _look():
    """A stand-in model: an object's hues are its vector."""
    return lambda x: x


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = Pack("look", "promo", can_extract_embedding=True, embedding_name="look", can_cluster=True, cluster_name="look", cluster_threshold=0.95)
    hues = lambda objects: objects.select("path", F.col("o.obj_id").alias("obj_id"), F.col("o.attr.hue_hist").alias("input"))
    return cluster.cluster_counts(embed.clustered(derived.library(spark, sf_dir), pack, hues, _look, [32]).images, "look")


frame("etl11_embedding_clusters", _embedded, f"""{PRELUDE.replace("WITH img", "WITH RECURSIVE img")}, h AS (SELECT r, list(CAST((r + i * i) % 17 AS DOUBLE) ORDER BY i) AS v FROM range(17) x(r), range(32) y(i) GROUP BY r),
  e AS (SELECT a.r AS a, b.r AS b FROM h a JOIN h b ON list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.95),
  t(r, s) AS (SELECT r, r FROM h UNION SELECT t.r, e.b FROM t JOIN e ON e.a = t.s),
  g AS (SELECT r, min(s) AS g FROM t GROUP BY r),
  m AS (SELECT g, path, pos FROM img JOIN obj USING (k) JOIN g ON p % 17 = r WHERE class = 'promo'),
  n AS (SELECT g, row_number() OVER (ORDER BY min((path, pos))) AS n FROM m GROUP BY g)
  SELECT 'look_promo_' || lpad(CAST(n AS VARCHAR), 3, '0') AS cluster_id, count(DISTINCT path) AS images FROM m JOIN n USING (g) GROUP BY n""")

# scripts, results and albums
dsl("ses3_recovery", "x = = 3; $ any promo", f"{PRELUDE} SELECT path, {R6} FROM ({HAS_PROMO})")
dsl("set8_left_to_right", "$ - ($ any promo) - ($ any small)", f"{PRELUDE} SELECT path, CAST(1 AS DOUBLE) AS score FROM img WHERE path NOT IN (SELECT path FROM ({HAS_PROMO})) AND path NOT IN (SELECT path FROM ({HAS_SMALL}))")
dsl("rel2_above_objects", "$ : (any(above(obj, obj)))", any_(sig("y - (y + h)")))
dsl("rel3_inside_objects", "macro grown(o) = o.w; $ : (any(inside(obj, obj) && grown(obj) > 0.4))", any_(f"least(CAST(0.5 AS FLOAT), {sig('w - 0.4')})"))
frame("src14_smart_album", lambda s, d: sources.smart_album("$ any promo", Session(derived.library(s, d))), f"{PRELUDE} SELECT path, {R6} FROM ({HAS_PROMO})")


def _answer(script: str):
    """A script's JSON answer, read back."""
    return lambda s, d: s.createDataFrame([(Session(derived.library(s, d)).run_json(script),)], "answer string").select(F.from_json("answer", "type string, value double, message string").alias("a")).select("a.*")


def _refused(spark: SparkSession, sf_dir: str, script: str) -> DataFrame:
    """The error answer of a script, and what the session still holds after it: all images, and those of a class that a query finds."""
    session = Session(derived.library(spark, sf_dir))
    answer = spark.createDataFrame([(session.run_json(script),)], "answer string").select(F.from_json("answer", "type string, message string").alias("a")).select("a.*")
    whole = session.library.images.agg(F.count(F.lit(1)).alias("images"))
    named = session.run("$ any promo").table().agg(F.count(F.lit(1)).alias("named"))
    return answer.join(F.broadcast(whole)).join(F.broadcast(named))  # one row each


LEFT = f"{PRELUDE} SELECT 'error' AS type, (SELECT count(*) FROM img) AS images, count(DISTINCT path) AS named FROM ({HAS_PROMO})"


frame("snk2_scalar", lambda s, d: _answer("cnt(goods)")(s, d).select("type", "value"), f"{PRELUDE} SELECT 'scalar' AS type, CAST(count(*) AS DOUBLE) AS value FROM obj WHERE class <> 'promo'")
frame("snk3_error", lambda s, d: _refused(s, d, "^ $").select("type", "images", "named"), LEFT)
frame("cmp11_mixed_types", lambda s, d: _refused(s, d, "$ : (img_camera() > 3)"), LEFT.replace("AS type", "AS type, 'Type mismatch in binary operation' AS message"))
frame("set7_different_types", lambda s, d: _refused(s, d, "($ any promo) | (% $)").select("type", "images", "named"), LEFT)
frame("nlq2_delete_refused", lambda s, d: _refused(s, d, "del ($ any promo)").select("type", "images", "named"), LEFT)
frame("snk8_warmup", lambda s, d: s.createDataFrame([(Session(derived.library(s, d)).warmup(),)], "answer string").select(F.get_json_object("answer", "$.images").cast("long").alias("images")), f"{PRELUDE} SELECT count(*) AS images FROM img")


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "library")
    sources.write_snapshot(derived.library(spark, sf_dir).images, folder, "base")
    i = sources.read_snapshot(spark, folder, "base")
    return i.select("path", "img_id", F.size("objects").alias("objects"), F.col("img_attrs.dominant_scene").alias("scene"))


frame("snk6_snapshot", _snapshot, f"{PRELUDE} SELECT path, k AS img_id, CAST(count(p) AS INT) AS objects, scene FROM img LEFT JOIN obj USING (k) GROUP BY path, k, scene")



def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library as a packed JSON index in parts, read back in chunks."""
    folder = new_path(spark, "index")
    sources.write_index(derived.library(spark, sf_dir).images, folder, packed=True)
    i, _ = sources.read_index(spark, f"{folder}/part-*.json.gz", 4 << 20)
    o = F.transform("objects", lambda x: x["class"])
    return i.select("path", "mtime", "size", "img_id", F.array_join(o, ",").alias("classes"), F.col("img_attrs.dominant_scene").alias("scene"), F.col("img_attrs.user_tags")["priority"].alias("priority"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set's answer as JSON files, read back."""
    folder = new_path(spark, "answer")
    Session(derived.library(spark, sf_dir)).run("$ any promo").write_json(folder)
    rows = pieces.Document(spark, f"{folder}/part-*.json").section("images")
    return rows.select(F.from_json("value", "path string, score double").alias("r")).select("r.path", F.round("r.score", 6).alias("score"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's pages, read back card by card."""
    folder, lib = new_path(spark, "report"), derived.library(spark, sf_dir)
    catalog.write_report(catalog.report(lib, Session(lib).run("$ any promo").rows()), folder, "Promo")
    t = spark.read.text(f"{folder}/part-*.html").where("value like '<div>%'")
    of = lambda k: F.regexp_extract("value", f"<p>{k}: (.*?)</p>", 1).alias(k)
    return t.select(F.regexp_extract("value", "<h2>(.*) [0-9.]+</h2>", 1).alias("path"), of("colour"), F.size(F.split(of("objects"), ", ")).alias("objects"), of("tags"))


frame("src7_index", _index, f"{PRELUDE} SELECT path, CAST(epoch(o_orderdate) AS BIGINT) AS mtime, c AS size, k AS img_id, coalesce(string_agg(class, ',' ORDER BY pos), '') AS classes, scene, priority FROM img JOIN orders ON o_orderkey = k LEFT JOIN obj USING (k) GROUP BY path, o_orderdate, c, k, scene, priority")
frame("snk1_answer_files", _answers, f"{PRELUDE} SELECT path, {R6} FROM ({HAS_PROMO})")
frame("snk10_report_files", _reports, f"{PRELUDE}, h AS (SELECT path FROM ({HAS_PROMO}) WHERE score >= 0.05) SELECT path, img.colour AS colour, CAST(count(*) AS INT) AS objects, 'priority=' || priority || ', status=' || status AS tags FROM img JOIN obj USING (k) JOIN h USING (path) GROUP BY path, img.colour, priority, status")

# building
frame("srt3_top_scenes", lambda s, d: derived.library(s, d).images.select("path", F.posexplode(etl.top_scenes(F.col("img_attrs.scene_vector"), derived.LABELS)).alias("place", "t")).select("path", "place", "t.p", "t.label"),
      f"""{PRELUDE} SELECT path, CAST(row_number() OVER (PARTITION BY k ORDER BY n DESC, i) - 1 AS INT) AS place, round(CAST(CAST(n / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE), 6) AS p,
    CASE WHEN i % 5 = 0 THEN 'place ' || CAST(i AS VARCHAR) ELSE 'scene-' || CAST(i % 350 AS VARCHAR) || ' ' || chr(CAST(97 + i % 26 AS INT)) END AS label
  FROM (SELECT path, k, i, (k + i * i) % 17 AS n FROM img, range(365) r(i)) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, i) <= 5""")  # fmt: skip
frame("etl3_object_ids", lambda s, d: etl.with_object_ids(derived.library(s, d).images.select("path", "img_id", "objects"), 5_000_000).select("path", F.posexplode("objects").alias("pos", "o")).select("path", "pos", "o.obj_id", "o.img_id", "o.class"),
      f"{PRELUDE} SELECT path, CAST(pos - 1 AS INT) AS pos, 5000000 + row_number() OVER (ORDER BY path, pos) - 1 AS obj_id, k AS img_id, class FROM img JOIN obj USING (k)")
frame("etl10_scenes", lambda s, d: etl.completed(derived.library(s, d).images, derived.library(s, d), 0.7).select("path", F.col("img_attrs.dominant_scene").alias("scene"), F.size(F.filter("objects", lambda o: o["is_fallback"])).alias("unsure")),
      f"""{PRELUDE}, t AS (SELECT k, min(i) AS i FROM (SELECT k, i FROM img, range(365) r(i) QUALIFY (k + i * i) % 17 = max((k + i * i) % 17) OVER (PARTITION BY k)) GROUP BY k)
  SELECT path, CASE WHEN i % 5 = 0 THEN 'place ' || CAST(i AS VARCHAR) ELSE 'scene-' || CAST(i % 350 AS VARCHAR) || ' ' || chr(CAST(97 + i % 26 AS INT)) END AS scene,
    CAST(count(CASE WHEN conf < 0.7 AND super <> 'root' THEN 1 END) AS INT) AS unsure FROM img JOIN t USING (k) LEFT JOIN obj USING (k) GROUP BY path, i""")  # fmt: skip


def _found(f):
    """A stand-in model: one child in the upper left quarter of each parent."""
    return [[(int(i % 2), 0.4 + int(i % 7) / 10, 0.0, 0.0, 0.5, 0.5)] for i in f.obj_id]


def _children(spark: SparkSession, sf_dir: str, classify: bool) -> DataFrame:
    lib = derived.library(spark, sf_dir)
    pack = Pack("details", "promo", ("lid", "label"), conf_threshold=0.5, is_classifier=classify)
    s = Session(Library(lib.images, lib.collections, lib.classes, lib.labels, {"details": pack}), predictors={"details": _found})
    return s.run("(% $) >> details").objects().select("image_path", "o.class", "o.super_class", "o.parent_id", "o.img_id", "o.x", "o.w", "o.confidence", "score")


def _children_sql(left: str, width: str) -> str:
    return f"""{PRELUDE}, c AS (SELECT *, k * 1000 + pos AS id, greatest(0, x - w * 1.2 / 2) AS x1, least(1, x + w * 1.2 / 2) AS x2 FROM img JOIN (SELECT k, pos, class, super, x, w, conf FROM obj) o USING (k) WHERE class = 'promo')
  SELECT path AS image_path, CASE WHEN id % 2 = 0 THEN 'lid' ELSE 'label' END AS class, class AS super_class, id AS parent_id, k AS img_id,
    round(CAST(x1 + {left} * (x2 - x1) AS DOUBLE), 6) AS x, round(CAST({width} * (x2 - x1) AS DOUBLE), 6) AS w, round(CAST(0.4 AS DOUBLE) + (id % 7) / CAST(10 AS DOUBLE), 6) AS confidence,
    round(CAST(CAST(CAST(CAST(conf AS FLOAT) AS DOUBLE) * CAST(0.8999999761581421 AS DOUBLE) AS FLOAT) AS DOUBLE), 6) AS score FROM c WHERE id % 7 > 0"""


frame("udtf1_detect_children", lambda s, d: _children(s, d, False), _children_sql("0.25", "0.5"))
frame("udtf2_classify_children", lambda s, d: _children(s, d, True), _children_sql("0.5", "1"))
frame("clu4_density", lambda s, d: cluster.density(_vectors(s, d), 0.4, 3).select("id", F.coalesce("comp", F.lit(-1)).alias("noise_or_comp")), """WITH RECURSIVE e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id AND list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.4),
  core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 2),
  r(id, node) AS (SELECT id, id FROM core UNION SELECT r.id, e.b FROM r JOIN e ON r.node = e.a WHERE e.b IN (SELECT id FROM core)),
  c AS (SELECT id, min(node) AS comp FROM r GROUP BY id)
  SELECT vec_id AS id, coalesce(c.comp, (SELECT min(d.comp) FROM e JOIN c d ON e.b = d.id WHERE e.a = vec_id), -1) AS noise_or_comp FROM embeddings LEFT JOIN c ON c.id = vec_id""")
