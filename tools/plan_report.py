"""Summarise the physical plan of every registered query (exchanges,
broadcasts, Python stages, scan schemas) as a Markdown table.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from versio.plans.catalog import QUERIES  # noqa: E402
from versio.session import local_session  # noqa: E402


def summary(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange (RoundRobinPartitioning|hashpartitioning|rangepartitioning|SinglePartition)", plan)
    return {
        "shuffles": ", ".join(s.replace("partitioning", "").replace("Partitioning", "") for s in shuffles) or "none",
        "broadcasts": plan.count("BroadcastExchange"),
        "python": plan.count("ArrowEvalPython") + plan.count("MapInPandas") + plan.count("MapInArrow"),
        "scans": "; ".join(sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)))) or "(checkpoint)",
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on `{os.path.basename(sf)}` (`local[8]`). A query that dispatches has sent its requests when its\n"
          "plan is made: what is shown reads the written tables of the rounds (`(checkpoint)` where a plan reads only one of them).\n")
    print("| query | shuffles | broadcasts | Python stages | scan columns |")
    print("| --- | --- | --- | --- | --- |")
    for name, q in QUERIES.items():
        s = summary(q(spark, sf))
        print(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {s['python']} | `{s['scans']}` |")
    flagship = "translate_documents"
    plan = QUERIES[flagship](spark, sf)._jdf.queryExecution().executedPlan().treeString()
    print(f"\n## `{flagship}` physical plan (before adaptive re-planning)\n")
    print("```")
    print(plan.rstrip())
    print("```")


if __name__ == "__main__":
    main()
