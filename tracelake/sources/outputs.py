"""Written outputs, read again only when their files have changed."""

from __future__ import annotations

import json
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from tracelake.sources import store


def stamp(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of change of every file of an output; another stamp is another output."""
    fs, at = store._files(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(f"no output is written at {path}")
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


class Outputs:
    """Outputs of one session by path, at most `most` of them, the least lately used go first.

    Tables are kept by Spark, on disk where memory lacks, and are read anew if executors are lost; a rewritten output is
    seen at the next call, since every call compares the files' stamps. A table in use while its files are rewritten
    should be asked for again.
    """

    def __init__(self, spark: SparkSession, most: int = 16):
        if most < 1:
            raise ValueError("at least one output must be held")
        self.spark, self.most = spark, most
        self._held: OrderedDict[tuple[str, str], tuple[tuple, object]] = OrderedDict()

    def _get(self, kind: str, path: str, read):
        now, key = stamp(self.spark, path), (kind, path)
        if key in self._held and self._held[key][0] == now:
            self._held.move_to_end(key)
            return self._held[key][1]
        self._drop(key)  # first: Spark keeps tables by plan, and the rewritten output has the same one
        made = read()
        self._held[key] = (now, made)
        while len(self._held) > self.most:
            self._drop(next(iter(self._held)))
        return made

    def _drop(self, key: tuple[str, str]) -> None:
        _, made = self._held.pop(key, (None, None))
        if isinstance(made, DataFrame):
            made.unpersist()

    def table(self, path: str, schema: str | None = None) -> DataFrame:
        """A table written as CSV; without a schema all columns are text."""
        reader = self.spark.read.option("header", True).option("escape", '"')
        return self._get(f"table {schema}", path, lambda: (reader.schema(schema) if schema else reader).csv(path).persist())

    def json(self, path: str):
        """The value of a small JSON file (a report, a model)."""
        return self._get("json", path, lambda: json.loads(store.read_text(self.spark, path)))

    def text(self, path: str) -> str:
        return self._get("text", path, lambda: store.read_text(self.spark, path))

    def clear(self) -> None:
        for key in list(self._held):
            self._drop(key)
