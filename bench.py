"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every result is computed in
full and written to the no-op sink. The first query runs once untimed before.
"""

from __future__ import annotations

import json
import os
import time

from ligatable.plans.catalog import all_queries
from ligatable.session import build_session

HEADLINE = (
    "integrated_pairs",
    "minmax_by_source",
    "topk_drugs",
    "source_quality",
    "ppi_with_fallback",
    "network_edges",
    "index_ids",
    "aupr",
    "score_trend",
    "lead_compound",
    "compound_properties",
    "disease_associations",
    "parse_disease_json",
    "als_recommendations",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    # one untimed run, so that the first timing is not that of a cold JVM
    queries[names[0]](spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
