"""Albums, tags, renaming and reports over a library."""

from __future__ import annotations

import html
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import QueryError
from .operators import sets
from .operators.etl import top_scenes
from .sources import pages
from .sources.library import Library

RATING = "评分"
_TAGS = "img_attrs.user_tags"


# -- tags ----------------------------------------------------------------------------------------


def _on(images: DataFrame, chosen: DataFrame | None, change) -> DataFrame:
    """Change the tags of the chosen images (path), or of all."""
    if chosen is None:
        return images.withColumn("img_attrs", F.col("img_attrs").withField("user_tags", change(F.col(_TAGS))))
    mark = chosen.select("path").distinct().withColumn("_chosen", F.lit(True))
    out = images.join(mark, "path", "left")
    tags = F.when(F.col("_chosen"), change(F.col(_TAGS))).otherwise(F.col(_TAGS))
    return out.withColumn("img_attrs", F.col("img_attrs").withField("user_tags", tags)).drop("_chosen").select(*images.columns)


def set_tag(images: DataFrame, chosen: DataFrame | None, key: str, value: str) -> DataFrame:
    return _on(images, chosen, lambda t: F.map_concat(F.map_filter(t, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value))))


def remove_tag(images: DataFrame, chosen: DataFrame | None, key: str) -> DataFrame:
    return _on(images, chosen, lambda t: F.map_filter(t, lambda k, _: k != key))


def replace_tags(images: DataFrame, chosen: DataFrame | None, tags: dict[str, str]) -> DataFrame:
    new = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]).cast("map<string,string>")
    return _on(images, chosen, lambda t: new)


def rate(images: DataFrame, chosen: DataFrame | None, stars: int) -> DataFrame:
    if not 1 <= stars <= 5:
        raise QueryError("a rating is 1 to 5")
    return set_tag(images, chosen, RATING, str(stars))


def tag_keys(images: DataFrame) -> DataFrame:
    return images.select(F.explode(F.map_keys(_TAGS)).alias("key")).distinct().orderBy("key")


# -- albums --------------------------------------------------------------------------------------


def add_to_album(collections: DataFrame, name: str, paths: DataFrame) -> DataFrame:
    """Append paths to an album (created by its first), in order, without repeats."""
    name = name.strip()
    if not name:
        raise QueryError("an album needs a name")
    mine = collections.where(F.col("name") == name)
    new = paths.select("path").distinct().join(mine.select("path"), "path", "left_anti")
    last = mine.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    new = sets.numbered(new, F.asc("path")).crossJoin(F.broadcast(last))
    new = new.select(F.lit(name).alias("name"), (F.col("last") + F.col("place")).cast("int").alias("pos"), "path")
    return collections.unionByName(new)


def remove_from_album(collections: DataFrame, name: str, paths: DataFrame) -> DataFrame:
    gone = paths.select(F.lit(name).alias("name"), "path").distinct()
    return collections.join(gone, ["name", "path"], "left_anti").select(*collections.columns)


def rename_album(collections: DataFrame, old: str, new: str) -> DataFrame:
    return collections.withColumn("name", F.when(F.col("name") == old, F.lit(new.strip())).otherwise(F.col("name")))


def remove_album(collections: DataFrame, name: str) -> DataFrame:
    return collections.where(F.col("name") != name)


def albums(collections: DataFrame) -> DataFrame:
    return collections.groupBy("name").agg(F.countDistinct("path").alias("images")).orderBy("name")


# -- renaming ------------------------------------------------------------------------------------


def new_names(images: DataFrame, template: str) -> DataFrame:
    """old, new and conflict for a template with {index} {date} {scene} {object}; {index} follows the path.

    The first of several with one new name has it; the others, and names that other files have, conflict.
    """
    cut = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    date = F.regexp_replace(F.substring("img_attrs.datetime_original", 1, 10), "-", "")
    if "{index}" in template:
        images = images.join(sets.numbered(images.select("path"), F.asc("path"), out="_index"), "path")
    values: dict[str, Column] = {
        "{index}": F.col("_index").cast("string") if "{index}" in template else F.lit(""),
        "{date}": F.when(F.col("img_attrs.datetime_original") == "", "nodate").otherwise(date),
        "{scene}": F.when(F.col("img_attrs.dominant_scene") == "", "unknown").otherwise(F.col("img_attrs.dominant_scene")),
        "{object}": F.coalesce(F.get(F.col("objects"), F.lit(0))["class"], F.lit("unknown")),
    }
    name: Column = F.lit(template)
    for k, v in values.items():
        name = F.replace(name, F.lit(k), v)
    clean = F.concat(F.regexp_replace(name, r'[<>:"/\\|?*]', ""), cut)
    out = images.select(F.col("path").alias("old"), clean.alias("new"))
    claim = Window.partitionBy("new").orderBy("old")
    out = out.withColumn("_n", F.row_number().over(claim))
    taken = images.select(F.col("path").alias("new")).distinct().withColumn("_taken", F.lit(True))
    out = out.join(taken, "new", "left")
    return out.select("old", "new", ((F.col("_n") > 1) | (F.coalesce("_taken", F.lit(False)) & (F.col("new") != F.col("old")))).alias("conflict"))


def rename(library: Library, names: DataFrame, smart: dict[str, str] | None = None) -> tuple[Library, dict[str, str]]:
    """Rename by (old, new) where there is no conflict: images, albums, and quoted paths in saved queries."""
    ok = names.where(~F.col("conflict")).select("old", "new") if "conflict" in names.columns else names
    move = lambda df: df.join(ok, df["path"] == ok["old"], "left").withColumn("path", F.coalesce("new", "path")).select(*df.columns)
    out = Library(move(library.images), move(library.collections), library.classes, library.labels, library.packs, library.tasks)
    texts = dict(smart or {})
    if texts:
        # only the names that the saved queries quote are looked up
        quoted = sorted({q for t in texts.values() for q in t.split('"')[1::2]})
        to = {r["old"]: r["new"] for r in ok.where(F.col("old").isin(quoted)).collect()}
        # in one pass: a new name may be another's old one
        texts = {k: re.sub('"([^"]*)"', lambda m: f'"{to.get(m[1], m[1])}"', t) for k, t in texts.items()}
    return out, texts


# -- reports -------------------------------------------------------------------------------------


def report(library: Library, results: DataFrame, least: float = 0.05) -> DataFrame:
    """Cards of the results: score, colour, objects as ``class (conf%)``, likeliest scenes, tags.

    Results with their images' own columns (``Result.rows``) are not looked up; others meet cards of all images, which are narrow.
    """
    a = F.col("img_attrs")
    objects = F.transform("objects", lambda o: F.concat(o["class"], F.lit(" ("), F.format_string("%.0f", o["confidence"] * 100), F.lit("%)")))
    scenes = F.transform(top_scenes(a["scene_vector"], library.labels, 3, 0.001), lambda t: F.concat(t["label"], F.lit(" "), F.format_string("%.3f", t["p"].cast("double"))))
    tags = F.transform(F.array_sort(F.map_entries(a["user_tags"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    texts = [a["dominant_color"].alias("colour"), F.concat_ws(", ", objects).alias("objects"), F.concat_ws(", ", scenes).alias("scenes"), F.concat_ws(", ", tags).alias("tags")]
    rows = results.where(F.col("score") >= least)
    if "img_attrs" in results.columns:
        cards = rows.select("path", "score", *texts)
    else:
        cards = rows.join(library.images.select("path", *texts), "path")
    return cards.orderBy(F.desc("score"), "path")


def write_report(cards: DataFrame, folder: str, title: str = "Report") -> None:
    """The cards as HTML pages in ``folder``, one for each partition of their order, a card a line; tasks write them."""
    safe = lambda c: reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", " ")), c)
    body = [F.concat(F.lit(f"<p>{k}: "), safe(F.coalesce(k, F.lit(""))), F.lit("</p>")) for k in ("colour", "objects", "scenes", "tags")]
    text = F.concat(F.lit("<div><h2>"), safe(F.col("path")), F.lit(" "), F.format_string("%.3f", F.col("score").cast("double")), F.lit("</h2>"), *body, F.lit("</div>"))
    head = f"<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>\n"
    pages.write(cards.select(text.alias("text")), folder, pages.Form(head, "\n", "\n</body></html>", ".html"))


def report_html(cards: DataFrame, title: str = "Report") -> str:
    """The cards as one page; rows are streamed, not collected at once."""
    out = [f"<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for r in cards.toLocalIterator():
        body = "".join(f"<p>{k}: {html.escape(str(r[k]))}</p>" for k in ("colour", "objects", "scenes", "tags"))
        out.append(f"<div><h2>{html.escape(r['path'])} {r['score']:.3f}</h2>{body}</div>")
    return "".join([*out, "</body></html>"])
