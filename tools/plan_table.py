"""Physical-plan summary of every registered query (after execution, so AQE decisions show).

usage: python tools/plan_table.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nextbuy.plans.queries import QUERIES  # noqa: E402
from nextbuy.session import get_spark  # noqa: E402

PATTERNS = {
    "shuffle": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobinPartitioning",
    "single": r"Exchange SinglePartition",
    "bcast join": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "shj": r"ShuffledHashJoin",
    "nested loop": r"BroadcastNestedLoopJoin|CartesianProduct",
    "window": r"\bWindow\b",
    "group limit": r"WindowGroupLimit",
    "sort agg": r"SortAggregate",
    "python": r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas",
    "bucketed scan": r"Bucketed: true",
}


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16, extra_conf={"spark.driver.memory": "8g"})
    print(f"# Physical plans at {sf_dir}\n")
    print("Counts of plan nodes in the final (adaptive) plan of each registered query; multi-step queries")
    print("(stored snapshot, eager statistics) show only the last step. Produced by `tools/plan_table.py`.\n")
    print("| key | " + " | ".join(PATTERNS) + " |")
    print("|---|" + "---|" * len(PATTERNS))
    for key in sorted(QUERIES):
        df = QUERIES[key](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        c = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        print(f"| {key} | " + " | ".join(str(c[k]) if c[k] else "" for k in PATTERNS) + " |")
        sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
