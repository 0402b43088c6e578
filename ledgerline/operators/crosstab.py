"""Cross-tabs (A16-A18): every row value against every column value, with margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, NumericType, StructField, StructType

from ledgerline.functions.aggregates import Measure
from ledgerline.functions.values import all_of
from ledgerline.operators.levels import SET, level_totals
from ledgerline.session import write_down

WIDEST = 10_000  # columns of a wide table
CHUNK = 1000     # headers that a row value meets at once, about
MARGINS = ("cell", "row_total", "column_total", "grand_total")


def _filled_grid(cells: DataFrame, rows: Sequence[str], column: str, measures: Sequence[Measure]) -> DataFrame:
    """Adds the combinations without rows.

    The headers are dealt by hash into chunks of about ``CHUNK``; row values meet the chunks by number and then
    their headers, so no array grows with the headers. ``cells`` are read several times here, so they are
    expected to be written down already.
    """
    keys = [*rows, column]
    found = cells.select(column).distinct()
    chunks = max(1, -(-found.count() // CHUNK))
    headers = found.withColumn("__chunk", F.pmod(F.xxhash64(column), F.lit(chunks).cast("long"))).groupBy("__chunk").agg(F.collect_list(F.struct(column)).alias("__h"))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))
    grid = cells.select(*rows).distinct().withColumn("__chunk", F.explode(numbers)).join(headers, "__chunk") \
        .select(*rows, F.explode("__h").alias("__h")).select(*rows, F.col(f"__h.{column}").alias(column))
    side = cells.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[m.name for m in measures])
    match = all_of(F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))
    return grid.join(side, match, "left").select(*keys, *[m.filled(F.col(m.name)).alias(m.name) for m in measures])


def crosstab_cells(df: DataFrame, rows: Sequence[str], column: str, measures: Sequence[Measure],
                   dense: bool = True) -> DataFrame:
    """One row per cell, headers in typed order.

    ``rows`` may hold further attributes of the row (A18). A dense grid has a cell for every
    combination of a row and a header; a sparse one only where there are rows.
    """
    cells = level_totals(df, [*rows, column], [[*rows, column]], measures).drop(SET)
    if dense:
        cells = _filled_grid(write_down(cells), rows, column, measures)
    return cells.orderBy(*[F.col(c).asc_nulls_first() for c in (*rows, column)])


def crosstab_wide(df: DataFrame, rows: Sequence[str], column: str, measure: Measure,
                  values: Sequence | None = None, max_columns: int = WIDEST) -> DataFrame:
    """A16 with one output column per column value, named by its text (``null`` for null).

    Without ``values`` the distinct ones are read first; more than ``max_columns`` of them fail, as a
    table cannot be wider. A header missing in given ``values`` fails too. Rows are aggregated to cells
    before they are spread, so a hot row value is already small; the headers are numbered, null too,
    and the cells pivoted by number.
    """
    cells = level_totals(df, [*rows, column], [[*rows, column]], [measure]).drop(SET)
    if values is None:
        cells = write_down(cells)
        found = cells.select(column).distinct().orderBy(F.col(column).asc_nulls_first()).limit(max_columns + 1)
        values = [r[0] for r in found.collect()]
        if len(values) > max_columns:
            raise ValueError(f"more than {max_columns} values of {column}: use crosstab_cells")
    kind = df.schema[column].dataType
    headers = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], StructType([
        StructField("__no", IntegerType()), StructField("__value", kind)]))
    unknown = F.raise_error(F.concat(F.lit(f"no column is given for this value of {column}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    placed = cells.join(headers, F.col(column).eqNullSafe(F.col("__value")), "left") \
        .withColumn("__at", F.coalesce("__no", unknown.cast("int")))
    spread = placed.groupBy(*rows).pivot("__at", list(range(len(values)))).agg(F.max(measure.name))
    names = ["null" if v is None else str(v) for v in values]
    return spread.orderBy(*[F.col(r).asc_nulls_first() for r in rows]) \
        .select(*rows, *[measure.filled(F.col(f"`{i}`")).alias(n) for i, n in enumerate(names)])


def crosstab_totals(df: DataFrame, row: str | Sequence[str], column: str, cell: Measure,
                    row_total: Measure | None = None, column_total: Measure | None = None,
                    grand_total: Measure | None = None, name: str = "value", dense: bool = True) -> DataFrame:
    """Cells and margins in one frame; each margin is its own aggregate over source rows.

    ``row`` may be a row header with further attributes of the row (A18), all of which the row totals
    carry. ``margin`` tells cells from totals, since null is a legal header. Margins default to the
    cell's aggregate. Aggregates of unlike types, say a text and a count, are all shown as text.
    """
    rows = [row] if isinstance(row, str) else list(row)
    wanted = [cell, row_total or cell, column_total or cell, grand_total or cell]
    sets = [(*rows, column), tuple(rows), (column,), ()]
    unlike = list(dict.fromkeys((m.how, id(m.of) if isinstance(m.of, Column) else m.of, m.typed, m.approx, repr(m.empty)) for m in wanted))
    at = [unlike.index((m.how, id(m.of) if isinstance(m.of, Column) else m.of, m.typed, m.approx, repr(m.empty))) for m in wanted]
    measures = [Measure(f"__m{i}", m.how, m.of, None, m.typed, m.approx, m.empty) for i, m in sorted(dict(zip(at, wanted, strict=True)).items())]
    totals = level_totals(df, [*rows, column], sets, measures)
    kinds = {totals.schema[m.name].dataType for m in measures}
    as_text = len(kinds) > 1 and not all(isinstance(k, NumericType) for k in kinds)
    value, margin = F.lit(None), F.lit(None)
    for i, label in enumerate(MARGINS):
        shown = F.col(f"__m{at[i]}")
        value = F.when(F.col(SET) == i, shown.cast("string") if as_text else shown).otherwise(value)
        margin = F.when(F.col(SET) == i, F.lit(label)).otherwise(margin)
    out = totals.select(*rows, column, margin.alias("margin"), value.alias(name))
    if dense:
        out = write_down(out)
        is_cell = F.col("margin") == MARGINS[0]
        empty = str(cell.empty) if as_text and cell.empty is not None else cell.empty
        grid = _filled_grid(out.filter(is_cell), rows, column, [Measure(name, cell.how, cell.of, None, cell.typed, cell.approx, empty)])
        out = out.filter(~is_cell).unionByName(grid.withColumn("margin", F.lit(MARGINS[0])))
    place = F.when(F.col("margin").isin("column_total", "grand_total"), 1).otherwise(0)
    across = F.when(F.col("margin").isin("row_total", "grand_total"), 1).otherwise(0)
    return out.orderBy(place, *[F.col(r).asc_nulls_first() for r in rows], across, F.col(column).asc_nulls_first())
