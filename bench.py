"""Wall time of the headline queries as one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the warm
runs whose median counts; a query that takes over five seconds is timed once
after its warm-up.  Results are consumed whole by a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = """
a2_read_bzip2 a3_multiline_records b1_upsert c2_docket_rows c7_court_records d12_regex d13_fuzzy d16_full_text
e4_case_hierarchy e8_citation_network_nodes e9_many_seed_network e11_enhanced_search f12_clean_text
g7_validate_and_enrich g8_parse_stats g12_last_errors h3_inverted_index h6_import_totals i2_average_speed
i5_pagination j5_dedupe_ingests k1_search k3_search_advanced l1_resumable_ingest l4_throughput
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES

    from docketlake.catalog import QUERIES
    from docketlake.session import build_session

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        warm_up = once(name)
        repeats = runs if warm_up < 5 else 1
        times[name] = round(statistics.median(once(name) for _ in range(repeats)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
