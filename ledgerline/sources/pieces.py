"""Sources of one's own (G4) that tasks read piece by piece, in Arrow batches, less what filters rule out."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Mapping
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType


class Piece(InputPartition):
    """What one task reads: a ``token`` that says where it is, and the least and greatest value of columns."""

    def __init__(self, token: Any, bounds: Mapping[str, tuple[Any, Any]] | None = None):
        self.token, self.bounds = token, dict(bounds or {})

    def may_hold(self, wanted) -> bool:
        """Whether the filter can be true of any row; unknown bounds and unlike types rule nothing out."""
        low, high = self.bounds.get(".".join(wanted.attribute), (None, None))
        if low is None or high is None:
            return True
        inside = lambda v: v is not None and low <= v <= high
        try:
            if isinstance(wanted, In):
                return any(map(inside, wanted.value))
            if isinstance(wanted, EqualTo):
                return inside(wanted.value)
            end, compare = {GreaterThan: (high, operator.gt), GreaterThanOrEqual: (high, operator.ge),
                            LessThan: (low, operator.lt), LessThanOrEqual: (low, operator.le)}[type(wanted)]
            return wanted.value is not None and compare(end, wanted.value)
        except TypeError:
            return True


Pieces = Callable[[Mapping[str, str]], list[Piece]]
Read = Callable[[Any], Iterator]  # of a token, gives Arrow record batches


def read_pieces(spark: SparkSession, name: str, schema: StructType | str, pieces: Pieces, read: Read,
                options: Mapping[str, str] | None = None, used_once: bool = False) -> DataFrame:
    """A frame of the batches that ``read`` makes of each piece, one task a piece.

    ``pieces`` lists them from the options. Both functions run in Python workers and should import what they
    need. Without pieces the frame is empty.

    With ``used_once`` filters are pushed down: pieces whose bounds rule out matching rows are not read, and
    Spark still tests the rows. Spark 4.1 plans a loaded frame's pieces once and would keep those of one filter for
    another use of the frame, so the frame must then be used by a single query, in a single place.
    """

    class Reader(DataSourceReader):
        def __init__(self, given):
            self.given, self.filters = given, []

        def partitions(self):
            return [p for p in pieces(self.given) if all(p.may_hold(f) for f in self.filters)]

        def read(self, partition):
            if partition is not None:
                yield from read(partition.token)

    class PrunedReader(Reader):
        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                    self.filters.append(f)
                yield f

    made = PrunedReader if used_once else Reader

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def reader(self, schema):
            return made(dict(self.options))

    if used_once:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default in sessions of others
    spark.dataSource.register(Source)
    return spark.read.format(name).schema(schema).options(**(options or {})).load()


def _opened(uri: str):
    """The file system and path of a file that Spark names."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlsplit(uri).path)
    return fs.FileSystem.from_uri(uri)


def parquet_pieces(*columns: str) -> Pieces:
    """Lists the row groups of the files in the option ``files`` (a line each), with the bounds of ``columns``."""

    def listed(options):
        import pyarrow.parquet as pq

        found = []
        for uri in filter(None, options.get("files", "").split("\n")):
            system, path = _opened(uri)
            with system.open_input_file(path) as f:
                meta = pq.ParquetFile(f).metadata
            for group in range(meta.num_row_groups):
                chunks = [meta.row_group(group).column(i) for i in range(meta.num_columns)]
                known = {c.path_in_schema: c.statistics for c in chunks if c.path_in_schema in columns}
                found.append(Piece((uri, group), {n: (s.min, s.max) for n, s in known.items() if s is not None and s.has_min_max}))
        return found

    return listed


def read_row_group(token: tuple[str, int]) -> Iterator:
    import pyarrow.parquet as pq

    uri, group = token
    system, path = _opened(uri)
    with system.open_input_file(path) as f:
        yield from pq.ParquetFile(f).iter_batches(row_groups=[group])
