"""Declared fields, introspection (S5) and typed projection on read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import values as V

# Which business type a native type name stands for, first match first.
BUSINESS_TYPES = (
    ("TIMESTAMP", "DATETIME"), ("DATETIME", "DATETIME"), ("DATE", "DATE"), ("BOOL", "BOOLEAN"),
    ("JSON", "JSON"), ("INT", "NUMBER"), ("NUM", "NUMBER"), ("DEC", "NUMBER"),
    ("DOUBLE", "NUMBER"), ("FLOAT", "NUMBER"), ("REAL", "NUMBER"),
)


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "STRING"
    alias: str | None = None
    primary_key: bool = False

    @property
    def metadata(self) -> dict:
        return {"alias": self.alias or self.name, "primary_key": self.primary_key}


def business_type(native: str | None) -> str:
    name = (native or "").upper()
    return next((business for part, business in BUSINESS_TYPES if part in name), "STRING")


def describe(df: DataFrame, primary_key: Sequence[str] = ()) -> list[Field]:
    """The fields of a frame from its schema alone; keys are declared, Spark reports none."""
    return [Field(f.name, business_type(f.dataType.typeName()), f.metadata.get("alias"), f.name in primary_key)
            for f in df.schema.fields]


def describe_tables(tables: dict[str, DataFrame], only: Sequence[str] | None = None,
                    primary_keys: dict[str, Sequence[str]] | None = None) -> dict[str, list[Field]]:
    """S5 for a whole source; ``only`` picks tables by name in any letter case."""
    wanted = None if only is None else {name.lower() for name in only}
    keys = primary_keys or {}
    return {name: describe(df, keys.get(name, ())) for name, df in tables.items()
            if wanted is None or name.lower() in wanted}


# The Spark types a declared type is read as.
SPARK_TYPES = {"NUMBER": T.DoubleType(), "BOOLEAN": T.BooleanType(), "STRING": T.StringType(),
               "JSON": T.StringType(), "DATE": T.StringType(), "DATETIME": T.StringType()}
MOMENT_TYPES = {"DATE": T.DateType(), "DATETIME": T.TimestampNTZType()}


def _typed(df: DataFrame, field: Field, on_error: str, parse_dates: bool) -> Column:
    if field.name not in df.columns:
        target = MOMENT_TYPES.get(field.type) if parse_dates else None
        return F.lit(None).cast(target or SPARK_TYPES[field.type])
    column = F.col(field.name)
    found = V.kind(df, field.name)

    def cast(c: Column, target) -> Column:
        value = c.try_cast(target)
        if on_error == "null":
            return value
        failure = F.raise_error(F.concat(F.lit(f"field {field.name} is no {field.type}: "), c.cast("string")))
        return F.when(value.isNotNull() | c.isNull(), value).otherwise(failure.cast(target))

    if field.type == "NUMBER":
        return column if found == V.NUMBER else cast(column, "double")
    if field.type == "BOOLEAN":
        return column if found == V.BOOLEAN else F.lower(V.plain_text(df, field.name)) == "true"
    if field.type in MOMENT_TYPES:
        if found in (V.DATE, V.DATETIME):
            return column
        return cast(column, MOMENT_TYPES[field.type]) if parse_dates else column.cast("string")
    return V.plain_text(df, field.name)


def typed_projection(df: DataFrame, fields: Sequence[Field], on_error: str = "raise",
                     parse_dates: bool = False) -> DataFrame:
    """Exactly the declared fields in their types; a field the source lacks is null.

    Columns that already have a number or date type stay as read, so filters still reach the scan.
    ``on_error="null"`` turns unreadable values into null instead of failing.
    """
    return df.select(*[_typed(df, f, on_error, parse_dates).alias(f.name, metadata=f.metadata) for f in fields])
