"""Ready reports over the test tables, one per operator, each with the SQL it must agree with."""

from ledgerline.reports import (  # noqa: F401  (importing registers the reports)
    aggregates, bands, blocks, crosstabs, drills, expressions, horizontals, joins, predicates, scans,
)
from ledgerline.reports.catalogue import REPORTS, Report, Tables  # noqa: F401
