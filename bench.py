"""Times the headline reports and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores; ``BENCH_ALL=1`` times
every registered report. The session is warmed up first; then each report is run once to warm up and
three times to count. Results are forced by a write that stores nothing, and the median counts. What
a run writes down goes to the folder in ``spark.checkpoint.dir`` and is removed after it.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.reports import REPORTS  # noqa: E402
from ledgerline.session import build_session, scratch  # noqa: E402

HEADLINE = (
    "simple_list", "param_filter", "pred_order", "scalar_functions", "map_dictionary", "join_chain", "join_full",
    "union_mapped", "agg_all", "agg_count_distinct", "subtotals", "subtotals_distinct", "parent_total",
    "detail_with_group_total", "merge_spans", "row_positions", "crosstab", "crosstab_totals", "horizontal_summary",
    "distinct_first", "crosstab_wide", "master_detail", "join_left", "loop_later_rows", "loop_lookup", "loop_aggregate", "loop_threshold", "block_rows", "drill_view",
)

WARM_UP = ("agg_all", "join_chain", "pred_order", "merged_list")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(REPORTS) if os.environ.get("BENCH_ALL") else list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH", os.path.join(os.getcwd(), "spark-warehouse", "bench"))})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def run(name: str) -> float:
        with scratch(spark):
            start = time.perf_counter()
            REPORTS[name](spark, folder).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

    for name in WARM_UP * 2:
        run(name)
    for name in names:
        taken = [run(name) for _ in range(runs + 1)]
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "total_report_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
