"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from statera.plans import catalog

HEADLINE = [
    "issuer_year_values", "metrics_long_with_reasons", "yoy_changes", "reconciliation_checks", "red_flags_latest", "parse_number_tokens", "classify_cells",
    "normalized_cells", "label_match", "claim_conflicts", "truth_conflicts", "score_outcomes", "eval_summary", "numeric_density", "choose_statement_set",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()  # call sites of columns: half the time of building wide plans
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
