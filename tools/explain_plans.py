"""Print the physical plan of registered queries (after a run, so AQE's final plan shows).

Usage: python tools/explain_plans.py [--sf DIR] [--summary] name ...

``--summary`` prints only joins, exchanges, scans with their pushed filters,
and codegen-less operators: the lines to look at when reviewing a plan.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shiprisk.plans import catalog  # noqa: E402
from shiprisk.session import build_session  # noqa: E402

KEEP = re.compile(r"Join|Exchange|Scan|PushedFilters|PartitionFilters|ReadSchema|AQEShuffleRead|Window|Generate|"
                  r"HashAggregate|SortAggregate|ObjectHashAggregate|BatchEvalPython|ArrowEvalPython|FlatMapGroups")


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--summary", action="store_true")
    ap.add_argument("names", nargs="+")
    a = ap.parse_args()
    spark = build_session()
    catalog.load_all()
    for n in a.names:
        df = catalog.QUERIES[n](spark, a.sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"===== {n}")
        if a.summary:
            for line in plan.splitlines():
                if KEEP.search(line):
                    print(re.sub(r"\[plan_id=\d+\]", "", line)[:220])
        else:
            print(plan)
    spark.stop()


if __name__ == "__main__":
    main()
