"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores, ``BENCH_QUERIES`` a
comma-separated list of queries or ``all``. Each query runs once to warm up and then
``BENCH_RUNS`` times; the median counts. Results go to a sink that reads every row and
column.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HEADLINE = (
    "token_map",
    "dir_rollup",
    "ext_tokens",
    "visible_totals",
    "glob_priority",
    "ignore_rules",
    "select_by_table",
    "sort_name_asc",
    "cache_upsert",
    "snapshot_diff",
    "patch_lines",
    "commit_range_merges",
    "bpe_tokens",
    "source_tree_full",
    "file_sections",
    "prompt_assembly",
    "render_prompt",
    "prompt_bpe_tokens",
)


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    from tokengrove import build_session
    from tokengrove.catalog import load

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    queries, _ = load()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": os.environ.get("BENCH_CHECKPOINTS") or tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
