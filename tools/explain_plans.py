"""Write the physical plans of the headline queries to docs/PLANS.md.

Usage: python tools/explain_plans.py [sf_dir]   (default /root/testdata/sf0.01)
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ("friends_two_hop_strict", "common_friend_count", "common_friend_all_callers", "relation_all_callers",
         "person_relation", "contacts_by_prestige_page", "contacts_result", "contacts_page_all_callers",
         "affinity_page_own_codes", "cogroup_values")


def main() -> None:
    from amity.plans.registry import QUERIES
    from amity.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(shuffle_partitions=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/explain_plans.py` on `{sf_dir}` (local[*], AQE on,",
           "automatic broadcasts off, as on tables that are too large for them; the plans",
           "below are the initial adaptive plans). Intermediates that are written once",
           "(`staged`) appear as scans.", ""]
    for name in NAMES:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        out += [f"## {name}", "", "```", plan.strip(), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
