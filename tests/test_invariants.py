"""Invariants of SURVEY §5 on the sf0.001 star."""

from pyspark.sql import functions as F

from pitchside.plans.questions import q4_pressure, q7b_aggression_bands, q8b_referee_bands
from pitchside.plans.transforms import t3_implied_probs, t10_ntile, t15_rates


def test_rates_add_to_100(star001):
    for df, cols in ((q4_pressure(star001), ("win_rate_with_pressure_pct", "draw_rate_with_pressure_pct",
                                             "loss_rate_despite_pressure_pct")),
                     (q7b_aggression_bands(star001), ("win_rate_pct", "draw_rate_pct", "loss_rate_pct")),
                     (q8b_referee_bands(star001), ("home_win_pct", "draw_pct", "away_win_pct")),
                     (t15_rates(star001), ("win_rate_pct", "draw_rate_pct", "loss_rate_pct"))):
        for r in df.collect():
            assert abs(sum(r[c] for c in cols) - 100.0) <= 0.015 * len(cols), r


def test_tile_sizes_differ_by_at_most_one(star001):
    sizes = [r["n"] for r in t10_ntile(star001).groupBy("goal_diff_quintile").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    bands = [r.team_match_rows for r in q7b_aggression_bands(star001).collect()]
    assert max(bands) - min(bands) <= 1


def test_probabilities_sum_to_one(star001):
    worst = t3_implied_probs(star001).select(
        F.max(F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - F.lit(1.0))).alias("e")).first().e
    assert worst < 1e-12
