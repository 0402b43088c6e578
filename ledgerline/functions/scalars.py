"""Text interpolation (E6), scalar functions F1-F5 and F7, and their open registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import values as V

# The accepted shapes of ISO dates and local date-times.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def text(df: DataFrame, *parts) -> Column:
    """Plain strings stay as they are, Columns are shown as display text."""
    return F.concat(*[V.display_text(df, p) if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def format_number(df: DataFrame, value, pattern: str) -> Column:
    """half-even decimal pattern; null gives empty text, other text stays."""
    value = _column(value)
    shown = F.call_function("format_number", V.number(df, value), F.lit(pattern))
    return F.coalesce(shown, V.plain_text(df, value), F.lit(""))


def format_date(df: DataFrame, value, pattern: str) -> Column:
    """dates, timestamps and ISO text by pattern; any other text stays, null gives empty text."""
    value = _column(value)
    found = V.kind(df, value)
    shown = V.plain_text(df, value)
    # A pattern with time letters cannot show a bare date, whose text then stays.
    wants_time = re.search("[aAhHkKmnNsS]", re.sub("'[^']*'", "", pattern)) is not None
    if found == V.DATETIME or found == V.DATE and not wants_time:
        return F.coalesce(F.date_format(value, pattern), F.lit(""))
    if found == V.DATE:
        return F.coalesce(value.cast("string"), F.lit(""))
    moment = F.when(shown.rlike(ISO_DATETIME), shown.try_cast("timestamp_ntz"))
    formatted = [F.date_format(moment, pattern)]
    if not wants_time:
        formatted.append(F.date_format(F.when(shown.rlike(ISO_DATE), shown.try_cast("date")), pattern))
    return F.coalesce(*formatted, shown, F.lit(""))


def round_half_up(df: DataFrame, value, digits: int = 0) -> Column:
    """half-up; null stays null, text that is no number stays as it is."""
    value = _column(value)
    if V.kind(df, value) == V.NUMBER:
        return F.round(value, digits)
    return F.coalesce(F.round(V.number(df, value), digits).cast("string"), V.plain_text(df, value))


def concat(df: DataFrame, *values) -> Column:
    """nulls are skipped, numbers keep their ``.0``."""
    return F.concat_ws("", *[V.plain_text(df, _column(v)) for v in values])


def truthy(df: DataFrame, value) -> Column:
    value = _column(value)
    found = V.kind(df, value)
    if found == V.BOOLEAN:
        return F.coalesce(value, F.lit(False))
    if found == V.NUMBER:
        return F.coalesce(value != 0, F.lit(False))
    if found == V.VOID:
        return F.lit(False)
    shown = V.plain_text(df, value)
    return F.coalesce(V.number(df, value) != 0,
                      (shown != "") & (F.lower(shown) != "false"), F.lit(False))


def if_else(df: DataFrame, *args) -> Column:
    """fewer than three arguments give null; branches of two types are both shown as text."""
    if len(args) < 3:
        return F.lit(None)
    yes, no = _column(args[1]), _column(args[2])
    kinds = {V.kind(df, yes), V.kind(df, no)} - {V.VOID}
    if len(kinds) > 1:
        yes, no = V.plain_text(df, yes), V.plain_text(df, no)
    return F.when(truthy(df, args[0]), yes).otherwise(no)


@dataclass(frozen=True)
class NumberShape:
    """How a cell format shows numbers: the power of ten they are scaled by, the digits after the
    point, whether thousands are separated, and what follows."""
    scale: int
    digits: int
    grouped: bool
    unit: str

    @classmethod
    def of(cls, pattern: str) -> NumberShape:
        point = re.search(r"\.(.*)", pattern)
        return cls(2 if "%" in pattern else 0, sum(c in "0#" for c in point[1]) if point else 0, "," in pattern, "%" * ("%" in pattern))

    def show(self, number: Column) -> Column:
        # Halves go up, unlike in number patterns, so the digits are settled before they are laid out.
        settled = F.round(number.cast("double") * 10 ** self.scale, self.digits)
        layout = ("#,##0" if self.grouped else "0") + "." * (self.digits > 0) + "0" * self.digits
        return F.concat(F.call_function("format_number", settled, F.lit(layout)), F.lit(self.unit))


def display_format(df: DataFrame, value, pattern: str | None) -> Column:
    """numbers in the shape of a cell format; text that is no number stays, null stays null."""
    value = _column(value)
    shown = V.display_text(df, value)
    if not pattern:
        return shown
    return F.coalesce(NumberShape.of(pattern).show(V.number(df, value)), F.when(value.isNotNull(), shown))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "format": format_number, "date": format_date, "round": round_half_up,
    "concat": concat, "if": if_else,
}


def register_function(name: str, build: Callable[..., Column]) -> None:
    FUNCTIONS[name] = build


def call(df: DataFrame, name: str, *args) -> Column:
    """A registered function by its case-sensitive name."""
    if name not in FUNCTIONS:
        raise ValueError(f"unknown function {name!r}; known: {sorted(FUNCTIONS)}")
    return FUNCTIONS[name](df, *args)
