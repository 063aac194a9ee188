"""Print a compact physical-plan report (exchanges, joins, scans) for registered queries.

usage: python tools/plan_report.py [sf_dir] key [key ...] [--full]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nextbuy.plans.queries import QUERIES  # noqa: E402
from nextbuy.session import get_spark  # noqa: E402


def main():
    args = [a for a in sys.argv[1:] if a != "--full"]
    full = "--full" in sys.argv
    sf_dir = args[0]
    spark = get_spark("local[8]", shuffle_partitions=16)
    for k in args[1:]:
        df = QUERIES[k](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString() if not full else None
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted") if full else plan
        ops = re.findall(r"(Exchange \w+|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|"
                         r"CartesianProduct|WindowGroupLimit|Window|HashAggregate|ObjectHashAggregate|SortAggregate|"
                         r"BatchEvalPython|ArrowEvalPython|FileScan parquet [\w.]+)", text)
        print(f"== {k}")
        from collections import Counter
        print("  ", dict(Counter(ops)))
        for line in text.splitlines():
            if "PushedFilters" in line or "ReadSchema" in line:
                print("   ", line.strip()[:220])
        if full:
            print(text)
    spark.stop()


if __name__ == "__main__":
    main()
