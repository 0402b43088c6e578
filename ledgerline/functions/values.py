"""Loosely typed values.

Report sources mix numbers and numeric text, and compare a missing value as the text ``null``.
Where both types are known the builders emit plain typed comparisons, so that filters reach the
scan; only mixed text and numbers pay for a parse per row.

Every builder takes the frame its values belong to, because the types decide the expression. A
value is a column name or a Column; for a name the type is known without analysing anything.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, TEXT, DATE, DATETIME, BOOLEAN, VOID, OTHER = (
    "number", "text", "date", "datetime", "boolean", "void", "other")

# The text a missing value compares as, and the spellings of the special doubles.
NULL_TEXT = "null"
NUMBER_SHAPE = r"^\s*[+-]?(NaN|Infinity|((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?))\s*$"

# Everything up to and including the space counts as blank when text is trimmed.
# The characters trimmed, and the names of the comparisons.
BLANKS = "".join(map(chr, range(0x21)))

COMPARE: dict[str, Callable] = {
    "EQ": operator.eq, "NE": operator.ne, "GT": operator.gt,
    "GE": operator.ge, "LT": operator.lt, "LE": operator.le,
}


def col_of(value) -> Column:
    """A name or a Column, as a Column."""
    return F.col(value) if isinstance(value, str) else value


def dtype(df: DataFrame, value: str | Column) -> T.DataType:
    if isinstance(value, str) and value in df.columns:
        return df.schema[value].dataType
    return df.select(col_of(value).alias("c")).schema[0].dataType


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMBER
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, T.DateType):
        return DATE
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return VOID if isinstance(data_type, T.NullType) else OTHER


def kind(df: DataFrame, value: str | Column) -> str:
    return kind_of(dtype(df, value))


def all_of(columns) -> Column:
    return reduce(operator.and_, columns, F.lit(True))


def any_of(columns) -> Column:
    return reduce(operator.or_, columns, F.lit(False))


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(BLANKS))


def parse_number(column: Column) -> Column:
    """Text as double, or null. The shape is tested first, as a failing cast is slow."""
    return F.when(column.rlike(NUMBER_SHAPE), column.try_cast("double"))


def number(df: DataFrame, value: str | Column) -> Column:
    """Numbers as they are, text parsed as double, anything else null."""
    found, column = kind(df, value), col_of(value)
    if found == NUMBER:
        return column
    return parse_number(column) if found == TEXT else F.lit(None).cast("double")


def plain_text(df: DataFrame, value: str | Column) -> Column:
    """The text a value compares and sorts as; numbers are written as doubles."""
    found, column = kind(df, value), col_of(value)
    if found == TEXT:
        return column
    return (column.cast("double") if found == NUMBER else column).cast("string")


def null_text(df: DataFrame, value: str | Column) -> Column:
    return F.coalesce(plain_text(df, value), F.lit(NULL_TEXT))


def display_text(df: DataFrame, value: str | Column) -> Column:
    """The text a value is shown as (E6): nothing for null, whole numbers without ``.0``."""
    data_type, column = dtype(df, value), col_of(value)
    if kind_of(data_type) != NUMBER or isinstance(data_type, T.IntegralType):
        return F.coalesce(column.cast("string"), F.lit(""))
    limit = float(2**63)
    double = column.cast("double")
    return (F.when(column.isNull(), F.lit(""))
            .when(double >= limit, F.lit(str(2**63 - 1)))
            .when(double <= -limit, F.lit(str(-(2**63))))
            .when(double == F.rint(double), double.try_cast("bigint").cast("string"))
            .otherwise(column.cast("string")))


def text_code(column: Column) -> Column:
    """Numeric text in one spelling, other text as it is."""
    return F.coalesce((parse_number(column) + F.lit(0.0)).cast("string"), column)


def code_text(df: DataFrame, value: str | Column) -> Column:
    """Equal for two values exactly when they are loosely equal (X2), so it can be a join key."""
    found, column = kind(df, value), col_of(value)
    if found == TEXT:
        return text_code(column)
    if found == NUMBER:
        return (column.cast("double") + F.lit(0.0)).cast("string")
    return column.cast("string")


# --- comparison with a literal ------------------------------------------------------------


def literal_text(value) -> str:
    if value is None:
        return NULL_TEXT
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def literal_number(value) -> float | int | Decimal | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float, Decimal)):
        return value
    if isinstance(value, str) and re.match(NUMBER_SHAPE, value):
        return float(value.strip().rstrip("fFdD"))
    return None


def literal_moment(value) -> Column | None:
    """A date or a time without zone as a typed literal; ISO text is read as one."""
    if isinstance(value, (date, datetime)):
        value = value.isoformat()
    if not isinstance(value, str):
        return None
    try:
        moment = datetime.fromisoformat(value.strip())
    except ValueError:
        return None
    bare = len(value.strip()) == len("2000-01-01")
    return F.lit(moment.date().isoformat()).cast("date") if bare else (
        F.lit(moment.isoformat()).cast("timestamp_ntz"))


def wide_order(column: Column) -> Column:
    """A key that sorts text by its 16-bit units, as report sources do: beyond U+FFFF a character is two units that
    stand before U+E000, whereas Spark's own order is that of code points."""
    return F.encode(column, "UTF-16BE")


def _order_text(op: str, a: Column, b: Column) -> Column:
    """The order of two texts. Where either is plain ASCII both orders agree, and the cheaper one does."""
    plain = COMPARE[op](a, b)
    if op in ("EQ", "NE"):
        return plain
    ascii_side = (F.octet_length(a) == F.length(a)) | (F.octet_length(b) == F.length(b))
    return F.when(ascii_side, plain).otherwise(COMPARE[op](wide_order(a), wide_order(b)))


def _ranked(op: str, column: Column, value, null_wins: bool) -> Column:
    """``column op value`` for a non-null value; a null column counts as ``null_wins``."""
    if isinstance(value, str) and op not in ("EQ", "NE") and any(c >= "\ue000" for c in value):
        # Below U+E000 both orders agree, and the plain one reaches the scan.
        column, value = wide_order(column), wide_order(F.lit(value))
    hit = COMPARE[op](column, value if isinstance(value, Column) else F.lit(value))
    return (hit | column.isNull()) if null_wins else (hit & column.isNotNull())


def _with_literal(df: DataFrame, op: str, operand: str | Column, value) -> Column:
    if op == "NE":
        return ~_with_literal(df, "EQ", operand, value)
    found, left = kind(df, operand), col_of(operand)
    if found in (NUMBER, DATE, DATETIME):
        typed = literal_number(value) if found == NUMBER else literal_moment(value)
        if typed is not None:
            return _ranked(op, left, typed, null_wins=op in ("GT", "GE"))
        if value is None:
            # Written out, a number or a date always sorts before the text of a missing value.
            return {"EQ": left.isNull(), "GE": left.isNull(), "GT": F.lit(False),
                    "LT": left.isNotNull(), "LE": F.lit(True)}[op]
    if found == BOOLEAN and isinstance(value, bool) and op == "EQ":
        return left.eqNullSafe(F.lit(value))
    as_text = literal_text(value)
    if found == TEXT:
        as_number = literal_number(value)
        if as_number is not None:
            parsed = number(df, operand)
            if op == "EQ":
                return F.coalesce(parsed == F.lit(as_number), F.lit(False))
            by_text = _ranked(op, left, as_text, null_wins=COMPARE[op](NULL_TEXT, as_text))
            return F.when(parsed.isNotNull(), COMPARE[op](parsed, F.lit(as_number))).otherwise(by_text)
        return _ranked(op, left, as_text, null_wins=COMPARE[op](NULL_TEXT, as_text))
    return _order_text(op, null_text(df, operand), F.lit(as_text))


# --- comparison of two columns ------------------------------------------------------------


def _null_is_greatest(op: str, a: Column, b: Column) -> Column:
    if op == "EQ":
        return a.eqNullSafe(b)
    missing = {"GT": a.isNull() & b.isNotNull(), "GE": a.isNull(),
               "LT": b.isNull() & a.isNotNull(), "LE": b.isNull()}[op]
    return F.coalesce(COMPARE[op](a, b), missing)


def _with_column(df: DataFrame, op: str, left: str | Column, right: Column) -> Column:
    if op == "NE":
        return ~_with_column(df, "EQ", left, right)
    a, b = kind(df, left), kind(df, right)
    moments = {DATE, DATETIME}
    if (a == b == NUMBER) or {a, b} <= moments:
        return _null_is_greatest(op, col_of(left), right)
    if a == b == BOOLEAN and op == "EQ":
        return col_of(left).eqNullSafe(right)
    by_text = _order_text(op, null_text(df, left), null_text(df, right))
    if {a, b} <= {NUMBER, TEXT}:
        x, y = number(df, left), number(df, right)
        return F.when(x.isNotNull() & y.isNotNull(), COMPARE[op](x, y)).otherwise(by_text)
    return by_text


def compare(df: DataFrame, op: str, left: str | Column, right) -> Column:
    """True or false, never null; ``right`` is a Column or a plain value."""
    if not isinstance(right, Column):
        return _with_literal(df, op, left, right)
    if kind(df, right) == VOID:
        return _with_literal(df, op, left, None)
    return _with_column(df, op, left, right)
