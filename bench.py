"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose
the data and the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioforge.plans import catalog  # noqa: E402
from folioforge.plans.standins import SOURCE_PARTITIONS  # noqa: E402
from folioforge.session import local_session  # noqa: E402

HEADLINE = [
    "enforce_punct_summary",
    "enforce_text",
    "house_rules_summary",
    "corrections_log",
    "forbidden_scan",
    "script_and_length_metrics",
    "chunks",
    "assemble_conversations",
    "markup_text",
    "sections",
    "parse_responses",
    "translate_flow_documents",
    "group_books",
    "history_page",
    "active_topn",
    "transition_jobs",
    "training_join",
    "progress_merge",
    "page_states",
    "rate_limit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    if cpus.isdigit():  # the tables are one row group each
        spark.conf.set(SOURCE_PARTITIONS, cpus)
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the executors
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
