"""A catalog of datasets and models by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rxflow.operators import profile
from rxflow.sources import tables


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    title: str = ""
    split_cols: tuple[str, ...] = ("split",)

    def read(self, spark: SparkSession, split: str | None = None, split_col: str | None = None) -> DataFrame:
        return tables.read_reactions(spark, self.path, split, split_col or self.split_cols[0])

    def entries(self, spark: SparkSession, split: str | None = None, split_col: str | None = None) -> DataFrame:
        return profile.entries(self.read(spark, split, split_col))

    def entities(self, spark: SparkSession, limit: int = 400) -> DataFrame:
        return profile.entity_options(self.read(spark), limit)


@dataclass(frozen=True)
class Model:
    """``load`` gives a predictor for ``operators.embed.predict``."""

    name: str
    load: Callable[[], Callable[..., Any]]
    config: dict[str, Any] = field(default_factory=dict)


class Catalog:
    def __init__(self) -> None:
        self._items: dict[tuple[type, str], Any] = {}

    def add(self, item: Dataset | Model) -> Dataset | Model:
        if (type(item), item.name) in self._items:
            raise ValueError(f"{item.name} is there already")
        self._items[type(item), item.name] = item
        return item

    def _get(self, kind: type, name: str) -> Any:
        if (kind, name) not in self._items:
            raise KeyError(f"no {kind.__name__.lower()} {name}; there are {', '.join(self.names(kind)) or 'none'}")
        return self._items[kind, name]

    def dataset(self, name: str) -> Dataset:
        return self._get(Dataset, name)

    def model(self, name: str) -> Model:
        return self._get(Model, name)

    def names(self, kind: type = Dataset) -> list[str]:
        return sorted(n for k, n in self._items if k is kind)
