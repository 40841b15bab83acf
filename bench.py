"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from anomaloom.plans.catalog import QUERIES
from anomaloom.session import build_session

HEADLINE = (
    "classify_sequences",
    "alerts",
    "extract_events",
    "extraction_stats",
    "assemble_sequences",
    "sequence_tails",
    "anomaly_type_stats",
    "timeline",
    "join_labels",
    "token_counts",
    "vocab_topk",
    "encode_sequences",
    "unknown_tokens",
    "stratified_split",
    "balanced_resample",
    "clean_floats",
    "feature_vectors",
    "canonical_labels",
    "valid_row_number",
    "sliding_windows",
    "cap_windows",
    "normalization_stats",
    "normalize",
    "confusion_matrix",
    "per_class_metrics",
    "roc_auc",
    "average_precision",
    "incident_record",
    "stream_alerts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
        },
    )
    names = sys.argv[1:] or HEADLINE
    # Start the JVM and load its classes outside the times.
    QUERIES["shuffle"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1).rstrip(".")) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
