"""A Python function over batches of whole texts; other columns go through untouched."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_texts(df: DataFrame, added: str, start: Callable[[], Callable[[list], dict[str, Sequence]]],
              text: str = "text") -> DataFrame:
    """``df`` with its column ``text`` replaced by the columns of the DDL ``added``.

    ``start`` runs once in each task and returns what turns a batch's texts into a sequence for each
    added column. Batches are Arrow's, so ids keep their type and nulls beside the texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if c != text]
    new = StructType.fromDDL(added)
    kinds = {f.name: f.type for f in to_arrow_schema(new)}

    def run(batches):
        import pyarrow as pa

        work = start()
        for batch in batches:
            made = work(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(made[name], type=kind) for name, kind in kinds.items()],
                names=kept + list(kinds))

    return df.mapInArrow(run, StructType([df.schema[c] for c in kept] + new.fields))
