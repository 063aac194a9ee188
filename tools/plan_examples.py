"""Write the formatted physical plans of a few representative queries (after execution).

usage: python tools/plan_examples.py [sf_dir] > docs/PLAN_EXAMPLES.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nextbuy.plans.queries import QUERIES  # noqa: E402
from nextbuy.session import get_spark  # noqa: E402

KEYS = ["seq_testset", "eval_map7_new", "an_topn_per_dim"]


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16)
    print(f"# Physical plans of representative queries ({sf_dir}, after execution)\n")
    for key in KEYS:
        df = QUERIES[key](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"file:/\S+", "<path>", plan)
        plan = re.sub(r"nextbuy_snap_[0-9a-f]+", "nextbuy_snap_<id>", plan)
        print(f"## {key}\n\n{QUERIES[key].__doc__}\n\n```\n{plan.strip()}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
