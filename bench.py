"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  The listing corpus is derived from the driver tables
and materialised once (``corpus_build``); every headline query then runs in
full over it and is timed with a full write-free action (``count`` of the
final rows after all columns are computed via a hash).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from framewright.plans.catalog import QUERIES  # noqa: E402
from framewright.plans.fixture_corpus import corpus_files  # noqa: E402
from framewright.session import get_session  # noqa: E402

HEADLINE = ["variable_locations", "stack_allocation", "label_report", "chat_examples",
            "eval_results", "eval_metrics", "strip_debug", "split_train_val", "length_batches"]


def consume(df):
    """Force every output column: aggregate a hash over all of them."""
    h = F.xxhash64(*df.columns) % 1000003
    return df.select(F.sum(h).alias("h"), F.count(F.lit(1)).alias("n")).collect()[0]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    t0 = time.time()
    n_files = corpus_files(spark, sf_dir).count()
    times["corpus_build"] = round(time.time() - t0, 3)
    n_functions = None
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t0 = time.time()
        row = consume(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
        if name == "stack_allocation":
            n_functions = row["n"]
    total = round(sum(v for k, v in times.items() if k != "corpus_build"), 3)
    out = {"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "files": n_files}
    for q, label in [("variable_locations", "functions_per_sec_variable_locations"),
                     ("chat_examples", "functions_per_sec_chat_examples"),
                     ("eval_metrics", "predictions_per_sec_eval_metrics")]:
        if n_functions and times.get(q):
            out[label] = round(n_functions / times[q], 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
