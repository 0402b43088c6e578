"""Horizontal bands: records across, totals to the right, groups merged across."""

from ledgerline.functions.aggregates import Measure
from ledgerline.operators.bands import GROUP, Summary, band, band_positions, group_list, merge_spans
from ledgerline.operators.horizontal import transpose, transpose_wide
from ledgerline.operators.ordering import number_rows
from ledgerline.reports.catalogue import report, rounded

BY_TYPE = """
    WITH rows AS (
        SELECT p_type, p_brand, COUNT(*) AS n, CAST(NULL AS VARCHAR) AS label, 2 AS level FROM part GROUP BY p_type, p_brand
        UNION ALL SELECT p_type, NULL, COUNT(*), p_type || ' all', 0 FROM part GROUP BY p_type
        UNION ALL SELECT NULL, NULL, COUNT(*), 'Total', -1 FROM part),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY level < 0, p_type, level < 1, p_brand, level < 2) - 1 AS position FROM rows)
"""


@report("""
    WITH r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS position FROM part)
    SELECT position, 'p_name' AS field, CAST(NULL AS DOUBLE) AS num, p_name AS text, CAST(NULL AS BOOLEAN) AS flag FROM r
    UNION ALL SELECT position, 'p_retailprice', p_retailprice, NULL, NULL FROM r
""")
def horizontal_band(t):
    return transpose(t.part, ["p_name", "p_retailprice"], ["p_partkey"])


@report(BY_TYPE + """
    SELECT position, 'p_type' AS field, CAST(NULL AS DOUBLE) AS num, p_type AS text, CAST(NULL AS BOOLEAN) AS flag FROM r
    UNION ALL SELECT position, 'label', NULL, label, NULL FROM r
    UNION ALL SELECT position, 'n', CAST(n AS DOUBLE), NULL, NULL FROM r
""")
def horizontal_summary(t):
    n = (Measure("n", "COUNT"),)
    rows = band(t.part, ["p_type", "p_brand"], measures=n, ordered=False,
                summaries=[Summary("p_type", n, (GROUP, " all")), Summary(None, n, ("Total",))])
    return transpose(band_positions(rows, ["p_type", "p_brand"], name="position"), ["p_type", "label", "n"])


@report("""
    WITH g AS (SELECT p_type, p_brand FROM part GROUP BY p_type, p_brand),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY p_type, p_brand) - 1 AS position, COUNT(*) OVER (PARTITION BY p_type) AS span,
                 ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_brand) = 1 AS head FROM g)
    SELECT position, 'p_type' AS field, CAST(NULL AS DOUBLE) AS num, p_type AS text, CAST(NULL AS BOOLEAN) AS flag FROM r
    UNION ALL SELECT position, 'p_brand', NULL, p_brand, NULL FROM r
    UNION ALL SELECT position, 'p_type__span', CAST(span AS DOUBLE), NULL, NULL FROM r
    UNION ALL SELECT position, 'p_type__head', NULL, NULL, head FROM r
""")
def horizontal_group_spans(t):
    rows = group_list(t.part, ["p_type", "p_brand"])
    rows = merge_spans(rows, ["p_type", "p_brand"], spans=["p_type"])
    placed = number_rows(rows, ["p_type", "p_brand"], "position")
    return transpose(placed, ["p_type", "p_brand", "p_type__span", "p_type__head"])


@report("""
    WITH g AS (SELECT c_mktsegment, COUNT(*) AS n, round(AVG(c_acctbal), 2) AS mean FROM customer GROUP BY c_mktsegment),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY c_mktsegment) - 1 AS position FROM g),
    cells AS (SELECT 'c_mktsegment' AS field, position, c_mktsegment AS v FROM r
              UNION ALL SELECT 'n', position, CAST(n AS VARCHAR) FROM r
              UNION ALL SELECT 'mean', position,
                  CASE WHEN mean = floor(mean) THEN CAST(CAST(mean AS BIGINT) AS VARCHAR) ELSE CAST(mean AS VARCHAR) END FROM r)
    SELECT field, MAX(v) FILTER (WHERE position = 0) AS c0, MAX(v) FILTER (WHERE position = 1) AS c1,
           MAX(v) FILTER (WHERE position = 2) AS c2, MAX(v) FILTER (WHERE position = 3) AS c3,
           MAX(v) FILTER (WHERE position = 4) AS c4, MAX(v) FILTER (WHERE position = 5) AS c5
    FROM cells GROUP BY field
""")
def horizontal_wide(t):
    rows = rounded(group_list(t.customer, ["c_mktsegment"], [Measure("n", "COUNT"), Measure("mean", "AVG", "c_acctbal")]), "mean")
    return transpose_wide(rows, ["c_mktsegment", "n", "mean"], 6, ["c_mktsegment"])
