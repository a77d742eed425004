"""Saved models and scripts: JSON by category and name, in a directory of any file system."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from flowstore.plans.pipeline import check, normalize, parse
from flowstore.sources import filesystem


class Library:
    """save, get, list and delete of JSON values; a save replaces the file in one step."""

    def __init__(self, directory: str, spark: SparkSession | None = None):
        self.directory = directory.rstrip("/")
        self.spark = spark or SparkSession.active()

    def _path(self, category: str, name: str) -> str:
        for part in (category, name):
            if not part or part in (".", "..") or any(c in part for c in "/\\:"):
                raise ValueError(f"no name: {part!r}")
        return f"{self.directory}/{category}/{name}.json"

    def save(self, category: str, name: str, value: object) -> None:
        filesystem.write_text(self.spark, self._path(category, name), json.dumps(value, indent=1, default=str))

    def get(self, category: str, name: str) -> object:
        text = filesystem.read_text(self.spark, self._path(category, name))
        if text is None:
            raise KeyError(f"{category}/{name}")
        return json.loads(text)

    def list(self, category: str) -> list[str]:
        return [n.removesuffix(".json") for n in filesystem.names(self.spark, f"{self.directory}/{category}") if n.endswith(".json")]

    def delete(self, category: str, name: str) -> bool:
        return filesystem.delete(self.spark, self._path(category, name))


class Scripts(Library):
    """Saved pipelines, changed step by step; what is saved has been checked."""

    category = "scripts"

    def put(self, name: str, steps: object, known: Sequence[str] = ()) -> None:
        """known: the parameters that a caller gives."""
        check(normalize(parse(steps)), set(known))
        self.save(self.category, name, {"steps": [dict(s) for s in steps], "params": list(known)})

    def steps(self, name: str) -> list[dict]:
        return list(self.get(self.category, name)["steps"])

    def _change(self, name: str, steps: list[dict]) -> None:
        self.put(name, steps, self.get(self.category, name)["params"])

    def insert(self, name: str, at: int, step: dict) -> None:
        steps = self.steps(name)
        steps.insert(at, step)
        self._change(name, steps)

    def replace(self, name: str, at: int, step: dict) -> None:
        steps = self.steps(name)
        steps[at] = step
        self._change(name, steps)

    def remove(self, name: str, at: int) -> None:
        steps = self.steps(name)
        del steps[at]
        self._change(name, steps)

    def move(self, name: str, at: int, to: int) -> None:
        steps = self.steps(name)
        steps.insert(to, steps.pop(at))
        self._change(name, steps)

    def load_into(self, catalog) -> None:
        """All saved scripts by name, for call_script and as views."""
        for name in self.list(self.category):
            catalog.scripts[name] = self.steps(name)
