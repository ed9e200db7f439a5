"""Write PLANS.md: the physical plan shape of every question and of the projection.

Plans are taken with auto-broadcast and AQE off, so the static plan shows what
a large cluster gets when nothing but the size-checked dimensions is small.
For each plan: joins, aggregations, and every shuffle exchange with the
operator under it (a partial aggregate means only aggregated rows move).

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pitchside.plans.ingest_star import write_star  # noqa: E402
from pitchside.plans.questions import QUESTIONS  # noqa: E402
from pitchside.session import get_spark, scratch_path  # noqa: E402
from pitchside.sources.fixtures import fixture_star, match_source_rows  # noqa: E402
from pitchside.sources.star import read_star  # noqa: E402


def clean(line: str) -> str:
    line = re.sub(r"#\d+L?", "", line)
    line = re.sub(r", \[plan_id=\d+\]", "", line)
    line = re.sub(r"\s+", " ", line.strip(" :+-*()0123456789"))
    return line[:110]


def summarize(df) -> list[str]:
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for i, l in enumerate(lines):
        if "Exchange" in l and "BroadcastExchange" not in l:
            below = clean(lines[i + 1]) if i + 1 < len(lines) else ""
            kind = "aggregated rows" if "HashAggregate" in below else "rows"
            out.append(f"shuffle `{clean(l)}` ← {kind}: `{below}`")
        elif any(k in l for k in ("SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin", "Window ")):
            out.append(f"`{clean(l)}`")
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 16)
    root = scratch_path(spark, "plan-report")
    write_star(fixture_star(spark, sf_dir), root, one_price=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    star = read_star(spark, root)
    print("# PLANS\n")
    print("Generated by `tools/plan_report.py` on a star as the loader stores it (auto-broadcast and AQE off; dimensions")
    print("are still broadcast by their size-checked hint). Q7B's NTILE runs selection jobs first; the plan")
    print("below is its final job. `rangepartitioning` exchanges sort the final result (one row per team,")
    print("season, referee or band); a `SinglePartition` exchange feeds a window over seasons (Q6) or referees (Q8B).")
    print("Every exchange over fact rows sits on a partial aggregate, except in the projection (the load).\n")
    print("## Projection of the driver's tables (`match_source_rows`, co-partitioned plan used at scale)\n")
    for s in summarize(match_source_rows(spark, sf_dir)):
        print(f"- {s}")
    for name, job in QUESTIONS.items():
        print(f"\n## {name}\n")
        for s in summarize(job(star)):
            print(f"- {s}")
    spark.stop()


if __name__ == "__main__":
    main()
