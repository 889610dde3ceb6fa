"""Time the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.inputs import prepare  # noqa: E402
from catalog.queries import QUERIES  # noqa: E402
from lexlake.session import WORK_DIR_SETTING, session  # noqa: E402

HEADLINE = (
    "marks_join",
    "stage_highlights",
    "csv_roundtrip",
    "token_stats",
    "bronze_merge",
    "silver_request_set",
    "define_flatten",
    "silver_merge",
    "golden_survivorship",
    "golden_merge",
    "translation_attach_contains",
    "usage_attach",
    "enrich_cached",
    "publish_merge",
    "publish_csv",
    "publish_ids",
    "worklist_substring",
    "worklist_form",
    "update_internal",
    "update_all",
    "update_all_worklist",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    folder = tempfile.mkdtemp(prefix="lexlake-bench-")
    os.environ.setdefault("SPARK_LOCAL_DIRS", folder)
    spark = session(
        "lexlake-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            WORK_DIR_SETTING: f"{folder}/work",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the executors' threads and the code generator before the clock runs
    spark.range(1_000_000).selectExpr("id % 7 AS k", "id").groupBy("k").sum("id").write.format("noop").mode(
        "overwrite"
    ).save()
    # inputs that stand in for stored tables and services are not what is timed
    prepare(spark, sf_dir)
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
