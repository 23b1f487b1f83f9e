"""A session over a library: variables, macros, options, statements and their results."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import QueryError
from .functions.macros import PRELUDE
from .operators import sets
from .plans import nodes as n
from .plans.compiler import Compiler, tag_predicate
from .plans.parser import parse
from .plans.values import Value
from .sources import pages
from .sources.library import Library


@dataclass(frozen=True)
class Result:
    """The value of a script."""

    value: Value

    @property
    def kind(self) -> str:
        return self.value.kind

    def table(self) -> DataFrame:
        """Images as (path, score), objects collapsed to images, scalars as one row (value)."""
        v = self.value
        if v.kind == "objects":
            return v.df.groupBy(F.col("image_path").alias("path")).agg(F.max("score").alias("score"))
        if v.df is None:
            raise QueryError("the script has no value")
        return v.df

    def objects(self) -> DataFrame:
        if self.kind != "objects":
            raise QueryError("not a set of objects")
        return self.value.df

    def rows(self) -> DataFrame:
        """Images with their score and, where the result has kept them, their own columns."""
        return self.value.rows if self.value.rows is not None else self.table()

    def ordered(self) -> DataFrame:
        """Least score first, ties by path."""
        return sets.ranked(self.table())

    def best_first(self, least: float = 0.05) -> DataFrame:
        """Greatest score first, ties by path, without the faintest."""
        return sets.ranked(self.table(), least, descending=True)

    def json(self) -> str:
        if self.value.is_set:
            rows = [{"path": r["path"], "score": r["score"]} for r in self.ordered().toLocalIterator()]
            return json.dumps({"type": "images", "images": rows}, ensure_ascii=False)
        if self.kind in ("num", "score", "text"):
            return json.dumps({"type": "scalar", "value": self.value.df.first()[0]}, ensure_ascii=False)
        return json.dumps({"type": "scalar", "value": None})

    def write_json(self, folder: str) -> None:
        """A set's answer as JSON files, each a whole document: ordered within and, by name, between them. Tasks write them."""
        if not self.value.is_set:
            raise QueryError("only sets are written in parts")
        rows = self.ordered().select(F.to_json(F.struct("path", F.col("score").cast("double").alias("score"))).alias("text"))
        pages.write(rows, folder, pages.Form('{"type": "images", "images": [\n', ",\n", "\n]}", ".json"))


class Session:
    """Runs scripts; variables stay between them. ``predictors`` maps a pack's name to its model."""

    def __init__(self, library: Library, hard: bool = False, tags: list[str] | None = None, allow_delete: bool = False, predictors: dict[str, Callable] | None = None, on_delete: Callable | None = None):
        self.library, self.hard, self.tags = library, hard, list(tags or [])
        self.allow_delete, self.predictors, self.on_delete = allow_delete, dict(predictors or {}), on_delete
        self.variables: dict[str, Value] = {}
        self.macros = {m.name: m for m in parse(PRELUDE)}
        self.errors: list[str] = []

    def compiler(self) -> Compiler:
        from .operators.expand import expander

        return Compiler(self.library, self.variables, self.macros, self.hard, tag_predicate(self.tags), expander(self.library, self.predictors))

    def run(self, script: str, use_out: bool = True) -> Result:
        """The last statement's value, or that of the variable ``out``; broken statements are skipped and kept in ``errors``."""
        self.errors, last = [], Value("none")
        for statement in parse(script):
            if isinstance(statement, n.Broken):
                self.errors.append(statement.message)
            else:
                last = self.statement(statement)
        return Result(self.variables["out"] if use_out and "out" in self.variables else last)

    def statement(self, node: n.Node) -> Value:
        if isinstance(node, n.MacroDef):
            self.macros[node.name] = node
            return Value("none")
        if isinstance(node, n.Assign):
            if node.name in self.variables:
                raise QueryError(f"{node.name} has a value already")
            self.variables[node.name] = v = self.compiler().top(node.value)
            return v
        if isinstance(node, n.Delete):
            return self.delete(self.compiler().top(node.target))
        return self.compiler().top(node)

    def delete(self, target: Value) -> Value:
        """Take images out of the library; the value is how many there were."""
        if not self.allow_delete:
            raise QueryError("deleting is not allowed in this session")
        if target.kind not in ("text", "images"):
            raise QueryError("del needs a path or a set of images")
        paths = target.df.select(F.col("value").alias("path")) if target.kind == "text" else target.df.select("path")
        if target.kind == "text":  # an absolute path names its file
            paths = paths.union(paths.select(F.element_at(F.split("path", "/"), -1))).distinct()
        gone = self.library.images.join(paths, "path", "left_semi")
        count = gone.agg(F.count(F.lit(1)).cast("double").alias("value"))
        if self.on_delete is not None:
            self.on_delete(gone.select("path"))
        images = self.library.images.join(paths, "path", "left_anti")
        albums = self.library.collections.join(paths, "path", "left_anti").select(*self.library.collections.columns)
        self.library = Library(images, albums, self.library.classes, self.library.labels, self.library.packs, self.library.tasks)
        return Value("num", F.col("value"), count)

    def run_json(self, script: str) -> str:
        try:
            return self.run(script).json()
        except (QueryError, PySparkException) as e:
            return json.dumps({"type": "error", "message": str(e)}, ensure_ascii=False)

    def warmup(self) -> str:
        return json.dumps({"type": "warmup", "images": self.library.images.count()})

    def reload(self, library: Library) -> None:
        """A new library; options and macros stay, variables go."""
        self.library, self.variables = library, {}

    def show(self, result: Result) -> str:
        """A result as text, one line for each image or the scalar."""
        if result.value.is_set:
            return "\n".join(f"{r['score']:.6f}  {r['path']}" for r in result.ordered().toLocalIterator())
        return "" if result.kind == "none" else str(result.value.df.first()[0])
