"""Benchmark: load the star schema once, then run the ten questions.

Usage: ``python bench.py`` with optional ``BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8). Prints one JSON line:
``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.

``load_star`` derives the star schema from the driver's tables and writes it
to the session's checkpoint folder (what the reference's loader does once),
as the loader stores it (a match with its odds);
every question then reads the written tables, as the reference's questions
read its database. ``q1_from_raw`` times one question computed straight from
the raw tables in one plan, for comparison. ``ingest_csv`` times the season-file
loader (I1-I11) on the same matches written out as CSV season files. Each question time is the median
of ``BENCH_RUNS`` (default 5) executions, plan building included; so is the
load (each run into a fresh folder; the questions read the last one). One
untimed pass of the projection warms the JVM first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitchside.plans.ingest import load_seasons  # noqa: E402
from pitchside.plans.ingest_star import write_star  # noqa: E402
from pitchside.plans.questions import QUESTIONS  # noqa: E402
from pitchside.session import get_spark, scratch_path  # noqa: E402
from pitchside.sources.fixtures import fixture_star, raw_season_rows  # noqa: E402
from pitchside.sources.star import read_star  # noqa: E402


RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def median_time(fn, runs: int) -> float:
    """Median wall time of ``runs`` executions (plan building included)."""
    times = []
    for _ in range(runs):
        t = time.time()
        fn()
        times.append(time.time() - t)
    times.sort()
    return round(times[len(times) // 2], 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                      extra={"spark.driver.memory": "16g"})
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    timings: dict[str, float] = {}
    # Untimed warm-up: JVM start, class loading and first code generation of the projection.
    fixture_star(spark, sf_dir).match.agg({"match_id": "count"}).collect()

    roots: list[str] = []

    def load() -> None:
        roots.append(scratch_path(spark, "bench-star"))
        write_star(fixture_star(spark, sf_dir), roots[-1], one_price=True)

    timings["load_star"] = median_time(load, RUNS)
    root = roots[-1]

    star = read_star(spark, root)
    for name, job in QUESTIONS.items():
        timings[name] = median_time(lambda: job(star).collect(), RUNS)
    # Season files: the projection rendered as CSV (one folder per season, untimed setup), then
    # the whole file loader timed: header check, parse, clean/quarantine, dimensions, fact, odds, write.
    csv_root = scratch_path(spark, "bench-seasons")
    (raw_season_rows(spark, sf_dir).write.partitionBy("source_file").option("header", True)
     .csv(csv_root))
    timings["ingest_csv"] = median_time(
        lambda: load_seasons(spark, csv_root, scratch_path(spark, "bench-ingested")), RUNS)

    timings["q1_from_raw"] = median_time(
        lambda: QUESTIONS["q1_consistency"](fixture_star(spark, sf_dir)).collect(), RUNS)

    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": timings, "sf": sf,
                      "cpus": cpus, "runs_per_query": RUNS, "warmup": True}))
    spark.stop()


if __name__ == "__main__":
    main()
