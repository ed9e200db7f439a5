"""Registered outputs of the reusable transforms.

Each function exposes one operator on the whole fact, returned either per
match / team-match row or aggregated per team, season or referee, so it can
be checked against its oracle on the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.football import (REFEREE_BAND_LABELS, band_label, card_total, confidence_band,
                                  expected_points, favourite, from_parts, point_parts, points, pressure_side, strict_least)
from ..functions.numeric import half_up_ratio, pct
from ..operators.broadcast import small_dim
from ..operators.filters import min_sample, period_delta, with_full_coverage
from ..operators.ntile import ntile_scalable
from ..operators.perspective import team_view
from ..sources.star import Star
from .questions import (ODDS_BOOKMAKER, all_seasons, priced_matches, referee_tiles,
                        season_names, team_match_aggression, team_names, team_season_points)

# Thresholds that split the teams at sf 0.01 (parameters of the min-sample filter).
MIN_TEAM_MATCHES_SPLIT = 3000


def t1_team_view(star: Star) -> DataFrame:
    """Both team-perspective rows of every match."""
    m = star.match.select("match_id", "season_id", "home_team_id", "away_team_id",
                          "full_time_home_goals", "full_time_away_goals", "home_shots_on_target",
                          "away_shots_on_target", "home_fouls", "away_fouls", "home_yellow_cards",
                          "away_yellow_cards", "home_red_cards", "away_red_cards")
    return team_view(m, ["goals_for", "goals_against", "shots_on_target", "fouls", "yellows", "reds"],
                     keep=["match_id", "season_id"])


def t2_season_points(star: Star) -> DataFrame:
    """League points per team and season."""
    return (team_season_points(star).join(team_names(star), "team_id").join(season_names(star), "season_id")
            .select("team_name", "season_name", "total_points"))


def t3_implied_probs(star: Star) -> DataFrame:
    """Margin-free outcome probabilities of every priced match."""
    return priced_matches(star, ODDS_BOOKMAKER).select("match_id", "p_home", "p_draw", "p_away")


def t4_expected_points(star: Star) -> DataFrame:
    """T4: actual and odds-expected points per team and season."""
    tv = team_view(priced_matches(star, ODDS_BOOKMAKER),
                   {"expected_points": (expected_points("p_home", "p_draw"), expected_points("p_away", "p_draw"))},
                   keep=["season_id", "full_time_result"])
    agg = (tv.groupBy("team_id", "season_id")
           .agg(F.count(F.lit(1)).alias("matches"),
                F.sum(points("full_time_result", F.col("side"))).alias("actual_points"),
                F.round(from_parts(F.sum(point_parts("expected_points"))), 3).alias("expected_points")))
    return (agg.join(team_names(star), "team_id").join(season_names(star), "season_id")
            .select("team_name", "season_name", "matches", "actual_points", "expected_points"))


def _prediction_counts(star: Star, label_col: str, label) -> DataFrame:
    odds = ("home_win_odds", "draw_odds", "away_win_odds")
    rows = star.matches_with_odds(None).select(
        "season_id", label.alias(label_col), (favourite(*odds) == F.col("full_time_result")).alias("correct"))
    agg = (rows.groupBy("season_id", label_col)
           .agg(F.count(F.lit(1)).alias("matches"), F.count_if("correct").alias("correct_predictions")))
    return agg.join(season_names(star), "season_id").select("season_name", label_col, "matches", "correct_predictions")


def t5_favourite(star: Star) -> DataFrame:
    """T5: favourite picks per season and how many were right."""
    return _prediction_counts(star, "predicted_result", favourite("home_win_odds", "draw_odds", "away_win_odds"))


def t6_confidence(star: Star) -> DataFrame:
    """Confidence bands per season and how many picks were right."""
    return _prediction_counts(star, "confidence_level",
                              confidence_band(strict_least("home_win_odds", "draw_odds", "away_win_odds")))


def t7_pressure_side(star: Star) -> DataFrame:
    """Pressing side per season and how often it won."""
    ps = pressure_side("home_shots_on_target", "away_shots_on_target")
    agg = (star.match.select("season_id", ps.alias("pressure_side"),
                             (ps == F.col("full_time_result")).alias("converted"))
           .groupBy("season_id", "pressure_side")
           .agg(F.count(F.lit(1)).alias("matches"), F.count_if("converted").alias("pressing_side_wins")))
    return agg.join(season_names(star), "season_id").select("season_name", "pressure_side", "matches", "pressing_side_wins")


def t8_aggression(star: Star) -> DataFrame:
    """Team-match rows and points per aggression index value (NULL included)."""
    return (team_match_aggression(star).groupBy("aggression_index")
            .agg(F.count(F.lit(1)).alias("team_match_rows"), F.sum("points").alias("points")))


def t9_cards(star: Star) -> DataFrame:
    """Yellow, red and weighted card totals per season (NULL as 0)."""
    m = star.match.select(
        "season_id",
        card_total("home_yellow_cards", "away_yellow_cards").alias("y"),
        card_total("home_red_cards", "away_red_cards").alias("r"),
        (card_total("home_yellow_cards", "away_yellow_cards")
         + card_total("home_red_cards", "away_red_cards", weight=2)).alias("w"))
    agg = m.groupBy("season_id").agg(F.sum("y").alias("total_yellows"), F.sum("r").alias("total_reds"),
                                     F.sum("w").alias("total_weighted_cards"))
    return agg.join(season_names(star), "season_id").select("season_name", "total_yellows", "total_reds",
                                                            "total_weighted_cards")


def t10_ntile(star: Star, n: int = 5) -> DataFrame:
    """NTILE(5) of all team-match rows by goal difference, ties by (match_id, side)."""
    rows = team_match_aggression(star).select("match_id", "side", "goal_diff")
    return ntile_scalable(rows, n, ["goal_diff", "match_id", "side"], out_col="goal_diff_quintile")


def t11_band_label(star: Star) -> DataFrame:
    """Referees ranked into card-intensity terciles and labelled (the middle frame of Q8B)."""
    refs = small_dim(star.referee.select("referee_id", F.col("name").alias("referee_name")))
    return (referee_tiles(star).join(refs, "referee_id")
            .select("referee_name", "ref_match_count", "ref_avg_weighted_cards", "card_intensity_tile",
                    band_label("card_intensity_tile", REFEREE_BAND_LABELS).alias("referee_group")))


def t12_coverage(star: Star, seasons: int | None = None) -> DataFrame:
    """Teams present in every season."""
    m = star.match.select("season_id", "home_team_id", "away_team_id")
    tv = team_view(m, keep=["season_id"])
    return (with_full_coverage(tv, "team_id", "season_id", all_seasons(star, seasons)).join(team_names(star), "team_id")
            .select("team_name", F.col("periods").alias("seasons_played")))


def t13_min_sample(star: Star, n: int = MIN_TEAM_MATCHES_SPLIT) -> DataFrame:
    """Teams with at least n team-match rows."""
    tv = team_view(star.match.select("home_team_id", "away_team_id"))
    counts = tv.groupBy("team_id").agg(F.count(F.lit(1)).alias("team_matches"))
    return min_sample(counts, "team_matches", n).join(team_names(star), "team_id").select("team_name", "team_matches")


def t14_delta(star: Star) -> DataFrame:
    """Average goals per season and its change from the previous season."""
    total = F.col("full_time_home_goals") + F.col("full_time_away_goals")
    agg = star.match.groupBy("season_id").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("g"))
    per_season = (agg.join(season_names(star), "season_id")
                  .select("season_name", half_up_ratio("g", "n", 2).alias("avg_total_goals")))
    return period_delta(per_season, "season_name", {"avg_total_goals_change": "avg_total_goals"})


def t15_rates(star: Star) -> DataFrame:
    """Win / draw / loss rates per team."""
    tv = team_view(star.match.select("home_team_id", "away_team_id", "full_time_result"),
                   keep=["full_time_result"])
    ftr, side = F.col("full_time_result"), F.col("side")
    agg = (tv.groupBy("team_id")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(ftr == side).alias("w"),
                F.count_if(ftr == "D").alias("d")))
    n, w, d = F.col("n"), F.col("w"), F.col("d")
    return (agg.join(team_names(star), "team_id")
            .select("team_name", n.alias("matches"), pct(w, n).alias("win_rate_pct"),
                    pct(d, n).alias("draw_rate_pct"), pct(n - w - d, n).alias("loss_rate_pct")))


TRANSFORMS = {
    "t1_team_view": t1_team_view,
    "t2_season_points": t2_season_points,
    "t3_implied_probs": t3_implied_probs,
    "t4_expected_points": t4_expected_points,
    "t5_favourite": t5_favourite,
    "t6_confidence": t6_confidence,
    "t7_pressure_side": t7_pressure_side,
    "t8_aggression": t8_aggression,
    "t9_cards": t9_cards,
    "t10_ntile": t10_ntile,
    "t11_band_label": t11_band_label,
    "t12_coverage": t12_coverage,
    "t13_min_sample": t13_min_sample,
    "t14_delta": t14_delta,
    "t15_rates": t15_rates,
}
