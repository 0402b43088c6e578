"""Report parameters (R1-R3) and name resolution."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parameter:
    name: str
    default: Any = None
    required: bool = False


def parameter(given: Mapping[str, Any], name: str) -> Column:
    """The value handed in from outside; null when absent."""
    value = given.get(name)
    return value if isinstance(value, Column) else F.lit(value)


def with_defaults(declared: list[Parameter], given: Mapping[str, Any]) -> dict[str, Any]:
    """R2: the given value, else the default, else null; a required parameter must end up set."""
    filled = dict(given)
    for parameter_ in declared:
        value = given.get(parameter_.name)
        value = parameter_.default if value is None else value
        if parameter_.required and (value is None or (isinstance(value, str) and value == "")):
            raise ValueError(f"parameter {parameter_.name!r} is required")
        filled[parameter_.name] = value
    return filled


def from_result(result: DataFrame) -> Column:
    """The single value of an earlier one-row, one-column result, read inside the same plan."""
    return result.scalar()


def resolve(name: str, given: Mapping[str, Any], local: Mapping[str, Column] | None = None,
            records: DataFrame | None = None) -> Column:
    """A local name such as ``group``, then a field of the current record, then a parameter."""
    if local and name in local:
        return local[name]
    if records is not None and name in records.columns:
        return F.col(name)
    return parameter(given, name)
