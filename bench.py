"""Benchmark the headline queries.

Runs each query over the whole tables of $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and materialises it with the
``noop`` sink (full computation, nothing collected). Prints one JSON line.

Before timing, every headline query runs once untimed on the smallest tables
($BENCH_WARMUP_DIR, default /root/testdata/sf0.001): JVM JIT and code
generation then happen outside the timed runs, as in a long-running session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nextbuy.plans.queries import QUERIES  # noqa: E402
from nextbuy.session import get_spark  # noqa: E402

HEADLINE = [
    "feat_table",          # clean -> impute -> featurize the raw snapshot table
    "clean_null_profile",
    "seq_trainset",        # per-customer histories for training
    "seq_testset",
    "seq_left_pad",
    "batch_assign",
    "eval_map7_new",       # MAP@7 on new products
    "eval_losses",
    "rec_format",          # ranked recommendation lists
    "rec_top7_tally",
    "an_topn_per_dim",
    "an_label_counts",
    "log_best_epoch",
    "eval_holdout",        # 24 logistic regressions fit + scored
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    conf = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    if os.environ.get("BENCH_EVENT_LOG_DIR"):
        conf.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG_DIR"]})
    spark = get_spark(f"local[{cpus}]", app_name="nextbuy-bench", shuffle_partitions=2 * cpus, extra_conf=conf)
    # warm-up, not timed: JVM class loading, JIT and code generation
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warm = warm_dir if os.path.isdir(warm_dir) else sf_dir
    for name in names:
        try:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001 - the timed run reports failures
            pass
    times, failed = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - report and keep timing the others
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"{name}: FAILED {failed[name]}", file=sys.stderr)
            continue
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "warmup": warm}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
