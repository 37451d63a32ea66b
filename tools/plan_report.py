"""Write PLANS.md: the physical plan shape of every registered query.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Each query runs once into the ``noop`` sink so the adaptive plan is final;
the table lists shuffles, table scans, join strategies and Python nodes.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tallyspark.plans import QUERIES  # noqa: E402
from tallyspark.session import build_session  # noqa: E402

SCAN = re.compile(r"FileScan parquet .*?Location: \w+\(\d+ paths\)\[[^\]]*/(\w+)\.parquet")


def shape(plan: str) -> dict[str, str]:
    scans = Counter(SCAN.findall(plan))
    return {
        "shuffles": str(len(re.findall(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition", plan))),
        "broadcasts": str(plan.count("BroadcastExchange")),
        "scans": ", ".join(f"{t}×{n}" for t, n in sorted(scans.items())),
        "joins": ", ".join(sorted({j for j in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin") if j in plan})),
        "top-k": "WindowGroupLimit" if "WindowGroupLimit" in plan else "",
        "python": "MapInArrow" if "MapInArrow" in plan else "",
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    print("# Physical plan shapes\n")
    print(f"Generated by `python tools/plan_report.py` on `{sf_dir}` (final adaptive plans).\n")
    print("| query | shuffles | broadcasts | scans | joins | top-k | python |")
    print("|---|---|---|---|---|---|---|")
    for key in sorted(QUERIES):
        df = QUERIES[key](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = shape(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{key}` | {s['shuffles']} | {s['broadcasts']} | {s['scans']} | {s['joins']} | {s['top-k']} | {s['python']} |")
    spark.stop()


if __name__ == "__main__":
    main()
