"""A data model that many reports share: datasets, relationships, dictionaries.

It only holds names and turns them into frames; Spark plans and runs everything.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators.dictionaries import map_codes
from ledgerline.operators.relations import Relationship, combine, components, qualify, union_mapped
from ledgerline.sources.readers import read_source
from ledgerline.sources.schema import Field, typed_projection


@dataclass(frozen=True)
class TableDataset:
    """One table or file set of one source; no fields means all columns as read."""

    source: str
    options: Mapping[str, Any]
    fields: Sequence[Field] = ()


@dataclass(frozen=True)
class UnionDataset:
    """Common columns and, per member dataset, which of its columns fill them."""

    fields: Sequence[Field]
    members: Sequence[tuple[str, Mapping[str, str]]]


@dataclass
class DataModel:
    spark: SparkSession
    datasets: dict[str, TableDataset | UnionDataset | DataFrame] = field(default_factory=dict)
    relationships: Sequence[Relationship] = ()
    dictionaries: dict[str, Any] = field(default_factory=dict)
    primary_keys: dict[str, Sequence[str]] = field(default_factory=dict)

    def frame(self, name: str) -> DataFrame:
        """The dataset under its own column names; unions may have unions as members."""
        if name not in self.datasets:
            raise ValueError(f"unknown dataset {name!r}; known: {sorted(self.datasets)}")
        ds = self.datasets[name]
        if isinstance(ds, DataFrame):
            return ds
        if isinstance(ds, TableDataset):
            return read_source(self.spark, ds.source, ds.options, ds.fields)
        columns = [f.name for f in ds.fields]
        united = union_mapped(columns, [(m, self.frame(m), mapping) for m, mapping in ds.members])
        return typed_projection(united, ds.fields)

    def _keys(self, name: str) -> Sequence[str]:
        if name in self.primary_keys:
            return self.primary_keys[name]
        return [f.name for f in getattr(self.datasets[name], "fields", ()) if f.primary_key]

    def combined(self, *names: str) -> DataFrame:
        """The datasets joined along their relationships, columns qualified by dataset."""
        frames = {n: qualify(self.frame(n), n) for n in names}
        keys = {n: self._keys(n) for n in names if not isinstance(self.datasets[n], DataFrame) or n in self.primary_keys}
        return combine(frames, self.relationships, names, keys)

    def labelled(self, df: DataFrame, column: str, dictionary: str, into: str) -> DataFrame:
        """F6 by the dictionary's name; an unknown name leaves every value."""
        return map_codes(df, column, self.dictionaries.get(dictionary), into)

    def sets(self, *names: str) -> list[list[str]]:
        """Which of the datasets belong to one joined set."""
        return components(names, self.relationships)
