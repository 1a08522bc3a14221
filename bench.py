"""Time the headline queries on one data folder; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and the local cores; BENCH_QUERIES, a comma-separated list, narrows
the queries.  Every query starts cold: what earlier ones have staged is deleted.  Its
time includes building its plan, every staged table it writes, and the full
evaluation of its result.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from chainrisk.plans import catalog

HEADLINE = [
    "transcript_scores",
    "document_scores",
    "bigram_counts",
    "panel_expand",
    "links_union",
    "name_match_topk",
    "score_panel",
    "value_weighted_links",
    "partner_larger_props",
    "firm_degree_table",
    "degree_links",
    "decline_rate_summary",
    "closeness_centrality",
    "ctl_return_quarter",
    "excess_return_cumulative",
    "regression_sample",
    "felm_coefficients",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("chainrisk-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_STAGE_DIR") or tempfile.mkdtemp(prefix="bench-stage-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").count()  # start the executors
    seconds: dict[str, float] = {}
    for name in names:
        catalog.forget(spark)
        start = time.perf_counter()
        catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
