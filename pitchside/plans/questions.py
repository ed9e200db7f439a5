"""The ten question jobs (Q1-Q8B) as pure functions of a :class:`Star`.

Shape shared by all of them: narrow column work on the fact (inside
whole-stage codegen), one or two hash aggregations with map-side partial
aggregation (so a hot team or referee never concentrates raw rows in one
task), a size-checked broadcast join to a name dimension, and a sort of a
result that has one row per team, season, referee or band.

Output column names are the reference's aliases verbatim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.football import (AGGRESSION_BAND_LABELS, DRAW, REFEREE_BAND_LABELS, aggression,
                                  band_label, card_total, confidence_band, expected_points, favourite,
                                  from_parts, implied_probs, point_parts, points, pressure_side, strict_least)
from ..functions.numeric import exact_mean, exact_stddev_pop, half_up_ratio, pct
from ..operators.broadcast import small_dim
from ..operators.filters import period_delta
from ..operators.ntile import ntile_scalable
from ..operators.perspective import team_view
from ..sources.star import Star

# Thresholds the reference hard-codes, kept as defaults of parameters.
MIN_HT_DEFICITS = 5
MIN_PRESSURE_MATCHES = 10
MIN_TEAM_MATCHES = 190
MIN_REFEREE_MATCHES = 30
ODDS_BOOKMAKER = "B365"


def team_names(star: Star) -> DataFrame:
    """Size-checked broadcast of (team_id, team_name)."""
    return small_dim(star.team.select("team_id", F.col("name").alias("team_name")))


def all_seasons(star: Star, seasons: int | None = None):
    """How many seasons full coverage means: ``seasons``, or as many as the season table has (a scalar subquery)."""
    return F.lit(seasons) if seasons is not None else star.season.agg(F.count(F.lit(1))).scalar()


def season_names(star: Star) -> DataFrame:
    """Size-checked broadcast of (season_id, season_name)."""
    return small_dim(star.season.select("season_id", F.col("name").alias("season_name")))


def known_seasons(star: Star, df: DataFrame) -> DataFrame:
    """Keep rows whose season exists (the reference's inner join to ``season``), as a broadcast semi join."""
    return df.join(small_dim(star.season.select("season_id")), "season_id", "left_semi")


# ---------------------------------------------------------------- Q1
def team_season_points(star: Star) -> DataFrame:
    """T1 -> T2 -> points per (team, season)."""
    m = known_seasons(star, star.match.select("season_id", "home_team_id", "away_team_id", "full_time_result"))
    tv = team_view(m, keep=["season_id", "full_time_result"])
    return (tv.groupBy("team_id", "season_id")
            .agg(F.sum(points("full_time_result", F.col("side"))).alias("total_points")))


def q1_consistency(star: Star, seasons: int | None = None) -> DataFrame:
    """Q1: per team with all seasons, mean season points, population spread, mean / (1 + spread)."""
    per_team = (team_season_points(star).groupBy("team_id")
                .agg(F.count(F.lit(1)).alias("seasons_played"),
                     F.sum("total_points").alias("s"),
                     F.sum(F.col("total_points").cast("decimal(19,0)") * F.col("total_points").cast("decimal(19,0)")).alias("ss"))
                .where(F.col("seasons_played") == all_seasons(star, seasons)))   # one row per (team, season): count = distinct seasons
    avg = exact_mean("s", "seasons_played")
    var = exact_stddev_pop("seasons_played", "s", "ss")
    return (per_team.join(team_names(star), "team_id")
            .select("team_name", avg.alias("avg_points"), var.alias("variation"),
                    (avg / (F.lit(1.0) + var)).alias("consistency_score"))
            .orderBy(F.desc("consistency_score"), "team_name"))


# ---------------------------------------------------------------- Q2
def priced_matches(star: Star, bookmaker: str | None = ODDS_BOOKMAKER) -> DataFrame:
    """Matches with all three odds present and positive, plus T3 implied probabilities."""
    odds = ("home_win_odds", "draw_odds", "away_win_odds")
    mo = star.matches_with_odds(bookmaker)
    for c in odds:
        mo = mo.where(F.col(c).isNotNull() & (F.col(c) > 0))
    ph, pd, pa = implied_probs(*odds)
    return known_seasons(star, mo.select("match_id", "season_id", "home_team_id", "away_team_id",
                                         "full_time_result", ph.alias("p_home"), pd.alias("p_draw"),
                                         pa.alias("p_away")))


def q2_expected_points(star: Star, seasons: int | None = None, bookmaker: str = ODDS_BOOKMAKER) -> DataFrame:
    """Q2: actual league points against points implied by the bookmaker's margin-free odds."""
    tv = team_view(priced_matches(star, bookmaker),
                   {"expected_points": (expected_points("p_home", "p_draw"), expected_points("p_away", "p_draw"))},
                   keep=["season_id", "full_time_result"])
    tv = tv.withColumn("actual_points", points("full_time_result", F.col("side")))
    per_season = (tv.groupBy("team_id", "season_id")
                  .agg(F.count(F.lit(1)).alias("n"), F.sum("actual_points").alias("sa"),
                       F.sum(point_parts("expected_points")).alias("se")))
    per_team = (per_season.groupBy("team_id")
                .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("seasons_covered"),
                     F.sum("sa").alias("sa"), F.sum("se").alias("se"))
                .where(F.col("seasons_covered") == all_seasons(star, seasons)))
    n, sa, se = F.col("n"), F.col("sa"), from_parts("se")
    return (per_team.join(team_names(star), "team_id")
            .select("team_name",
                    n.alias("matches_considered"),
                    "seasons_covered",
                    sa.cast("long").alias("total_actual_points"),
                    F.round(se, 2).alias("total_expected_points"),
                    half_up_ratio(sa, n, 3).alias("avg_actual_points_per_game"),
                    F.round(se / n, 3).alias("avg_expected_points_per_game"),
                    F.round(sa - se, 3).alias("points_over_expected"),
                    F.round((sa - se) / n, 3).alias("points_over_expected_per_game"))
            .orderBy(F.desc("points_over_expected_per_game"), "team_name"))


# ---------------------------------------------------------------- Q3
def half_time_deficits(star: Star) -> DataFrame:
    """Team rows of sides trailing at half time, with their full-time outcome flags."""
    m = known_seasons(star, star.match.where(F.col("half_time_result").isin("H", "A"))
                      .select("season_id", "home_team_id", "away_team_id", "full_time_result", "half_time_result"))
    tv = team_view(m, keep=["full_time_result", "half_time_result"])
    side, ftr = F.col("side"), F.col("full_time_result")
    return (tv.where(F.col("half_time_result") != side)
            .select("team_id", (ftr == side).alias("won"), (ftr == F.lit(DRAW)).alias("drew")))


def q3_comebacks(star: Star, min_games: int = MIN_HT_DEFICITS) -> DataFrame:
    """Q3: how often a team trailing at half time wins, draws or avoids defeat."""
    agg = (half_time_deficits(star).groupBy("team_id")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if("won").alias("w"), F.count_if("drew").alias("d"))
           .where(F.col("n") >= min_games))
    n, w, d = F.col("n"), F.col("w"), F.col("d")
    return (agg.join(team_names(star), "team_id")
            .select("team_name", n.alias("losing_ht_games"), w.alias("full_comebacks_to_win"),
                    d.alias("comebacks_to_draw"), (w + d).alias("comebacks_to_non_loss"),
                    pct(w, n).alias("win_comeback_pct"), pct(d, n).alias("draw_comeback_pct"),
                    pct(w + d, n).alias("non_loss_comeback_pct"))
            .orderBy(F.desc("win_comeback_pct"), F.desc("non_loss_comeback_pct"), "team_name"))


# ---------------------------------------------------------------- Q4
def pressure_rows(star: Star) -> DataFrame:
    """The pressing team of every match with a strict shots-on-target edge."""
    ps = pressure_side("home_shots_on_target", "away_shots_on_target")
    m = star.match.select(ps.alias("pressure_side"), "home_team_id", "away_team_id", "full_time_result")
    ftr, side = F.col("full_time_result"), F.col("pressure_side")
    return (m.where(side != "T")
            .select(F.when(side == "H", F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"),
                    (ftr == side).alias("won"), (ftr == F.lit(DRAW)).alias("drew"),
                    (ftr.isin("H", "A") & (ftr != side)).alias("lost")))


def pressure_counts(star: Star, min_matches: int = MIN_PRESSURE_MATCHES) -> DataFrame:
    """Per pressing team: matches, wins, draws and losses when it had more shots on target."""
    return (pressure_rows(star).groupBy("team_id")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("won").alias("w"),
                 F.count_if("drew").alias("d"), F.count_if("lost").alias("l"))
            .where(F.col("n") >= min_matches))


def q4_pressure(star: Star, min_matches: int = MIN_PRESSURE_MATCHES) -> DataFrame:
    """Q4: win / draw / loss rates of teams with more shots on target than the opponent."""
    n, w, d, l = (F.col(c) for c in "nwdl")
    return (pressure_counts(star, min_matches).join(team_names(star), "team_id")
            .select("team_name", n.alias("matches_with_pressure"), w.alias("wins_with_pressure"),
                    d.alias("draws_with_pressure"), l.alias("losses_despite_pressure"),
                    pct(w, n).alias("win_rate_with_pressure_pct"),
                    pct(d, n).alias("draw_rate_with_pressure_pct"),
                    pct(l, n).alias("loss_rate_despite_pressure_pct"))
            .orderBy(F.desc("win_rate_with_pressure_pct"), F.asc("loss_rate_despite_pressure_pct"), "team_name"))


# ---------------------------------------------------------------- Q5
def q5_scoring(star: Star) -> DataFrame:
    """Q5: per season, average goals (total, home, away, by half), shares and spread."""
    hg, ag = F.col("full_time_home_goals"), F.col("full_time_away_goals")
    ht = F.col("half_time_home_goals") + F.col("half_time_away_goals")
    agg = (star.match.groupBy("season_id")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(hg).alias("sh"), F.sum(ag).alias("sa"),
                F.sum(ht).alias("sht"), F.sum((hg + ag) * (hg + ag)).alias("ss")))
    n, sh, sa, sht, ss = (F.col(c) for c in ("n", "sh", "sa", "sht", "ss"))
    total = sh + sa
    return (agg.join(season_names(star), "season_id")
            .select("season_name", n.alias("matches"),
                    half_up_ratio(total, n, 2).alias("avg_total_goals"),
                    half_up_ratio(sh, n, 2).alias("avg_home_goals"),
                    half_up_ratio(sa, n, 2).alias("avg_away_goals"),
                    pct(sh, total).alias("pct_goals_by_home_team"),
                    half_up_ratio(sht, n, 2).alias("avg_first_half_goals"),
                    half_up_ratio(total - sht, n, 2).alias("avg_second_half_goals"),
                    pct(total - sht, total).alias("pct_goals_in_second_half"),
                    F.round(exact_stddev_pop(n, total, ss), 2).alias("goal_variability"))
            .orderBy("season_name"))


# ---------------------------------------------------------------- Q6
def prediction_rows(star: Star, bookmaker: str | None = None) -> DataFrame:
    """T5/T6 per priced match: was the favourite right, and the confidence band."""
    odds = ("home_win_odds", "draw_odds", "away_win_odds")
    mo = star.matches_with_odds(bookmaker)
    return mo.select("season_id",
                     (favourite(*odds) == F.col("full_time_result")).alias("correct"),
                     confidence_band(strict_least(*odds)).alias("confidence_level"))


def q6_bookmaker(star: Star, bookmaker: str | None = None) -> DataFrame:
    """Q6: per season, how often the favourite won, overall and at medium confidence, with changes."""
    medium = F.col("confidence_level") == "medium"
    agg = (prediction_rows(star, bookmaker).groupBy("season_id")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"),
                F.count_if(medium).alias("mn"), F.count_if(medium & F.col("correct")).alias("mc")))
    per_season = (agg.join(season_names(star), "season_id")
                  .select("season_name",
                          pct("c", "n").alias("overall_prediction_accuracy_pct"),
                          F.col("mn").alias("medium_confidence_match_count"),
                          pct("mc", "mn").alias("medium_confidence_accuracy_pct")))
    out = period_delta(per_season, "season_name", {
        "overall_accuracy_change_pp": "overall_prediction_accuracy_pct",
        "medium_confidence_accuracy_change_pp": "medium_confidence_accuracy_pct"})
    return out.select("season_name", "overall_prediction_accuracy_pct", "overall_accuracy_change_pp",
                      "medium_confidence_match_count", "medium_confidence_accuracy_pct",
                      "medium_confidence_accuracy_change_pp").orderBy("season_name")


# ---------------------------------------------------------------- Q7
def team_match_aggression(star: Star) -> DataFrame:
    """T1 -> T8/T2: one row per team and match with aggression, points and goal difference."""
    m = star.match.select("match_id", "season_id", "home_team_id", "away_team_id", "full_time_result",
                          "full_time_home_goals", "full_time_away_goals", "home_fouls", "away_fouls",
                          "home_yellow_cards", "away_yellow_cards", "home_red_cards", "away_red_cards")
    tv = team_view(m, ["fouls", "yellows", "reds", "goals_for", "goals_against"],
                   keep=["match_id", "season_id", "full_time_result"])
    return tv.select("match_id", "season_id", "side", "team_id", "fouls", "yellows", "reds",
                     aggression("fouls", "yellows", "reds").alias("aggression_index"),
                     points("full_time_result", F.col("side")).alias("points"),
                     (F.col("goals_for") - F.col("goals_against")).alias("goal_diff"))


def q7a_aggression(star: Star, min_matches: int = MIN_TEAM_MATCHES) -> DataFrame:
    """Q7A: per team, average aggression index, fouls, cards, points and goal difference."""
    agg = (team_match_aggression(star).groupBy("team_id")
           .agg(F.count(F.lit(1)).alias("n"),
                F.sum("points").alias("sp"), F.sum("goal_diff").alias("sgd"),
                F.sum("fouls").alias("sf"), F.count("fouls").alias("nf"),
                F.sum("yellows").alias("sy"), F.count("yellows").alias("ny"),
                F.sum("reds").alias("sr"), F.count("reds").alias("nr"),
                F.sum("aggression_index").alias("sag"), F.count("aggression_index").alias("nag"))
           .where(F.col("n") >= min_matches))
    return (agg.join(team_names(star), "team_id")
            .select("team_name", F.col("n").alias("matches"),
                    half_up_ratio("sag", "nag", 2).alias("avg_aggression_index"),
                    half_up_ratio("sf", "nf", 2).alias("avg_fouls_per_match"),
                    half_up_ratio("sy", "ny", 2).alias("avg_yellows_per_match"),
                    half_up_ratio("sr", "nr", 3).alias("avg_reds_per_match"),
                    half_up_ratio("sp", "n", 3).alias("avg_points_per_match"),
                    half_up_ratio("sgd", "n", 3).alias("avg_goal_diff_per_match"))
            .orderBy(F.desc("avg_aggression_index"), F.desc("avg_points_per_match"), "team_name"))


def aggression_tiles(star: Star, n: int = 3) -> DataFrame:
    """T10 over all team-match rows, ordered by aggression (NULLs first), ties by (match_id, side)."""
    rows = team_match_aggression(star).select("match_id", "side", "aggression_index", "points", "goal_diff")
    return ntile_scalable(rows, n, ["aggression_index", "match_id", "side"], out_col="aggression_tercile")


def q7b_aggression_bands(star: Star) -> DataFrame:
    """Q7B: team-match rows in aggression terciles and the outcomes of each band."""
    pts = F.col("points")
    agg = (aggression_tiles(star).groupBy("aggression_tercile")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("aggression_index").alias("sag"),
                F.count("aggression_index").alias("nag"), F.sum("points").alias("sp"),
                F.sum("goal_diff").alias("sgd"), F.count_if(pts == 3).alias("w"),
                F.count_if(pts == 1).alias("d"), F.count_if(pts == 0).alias("l")))
    return (agg.orderBy("aggression_tercile")
            .select(band_label("aggression_tercile", AGGRESSION_BAND_LABELS).alias("aggression_band"),
                    F.col("n").alias("team_match_rows"),
                    half_up_ratio("sag", "nag", 2).alias("avg_aggression_index"),
                    half_up_ratio("sp", "n", 3).alias("avg_points_per_match"),
                    half_up_ratio("sgd", "n", 3).alias("avg_goal_diff_per_match"),
                    pct("w", "n").alias("win_rate_pct"), pct("d", "n").alias("draw_rate_pct"),
                    pct("l", "n").alias("loss_rate_pct")))


# ---------------------------------------------------------------- Q8
def referee_matches(star: Star) -> DataFrame:
    """T9 per officiated match: NULL-as-zero yellow and red totals."""
    return (star.match.where(F.col("referee_id").isNotNull())
            .select("referee_id", "season_id", "full_time_result",
                    card_total("home_yellow_cards", "away_yellow_cards").alias("yellows_in_match"),
                    card_total("home_red_cards", "away_red_cards").alias("reds_in_match")))


def referee_seasons(star: Star) -> DataFrame:
    """Per referee and season: count, sums and extremes (the only pass over the fact for Q8A)."""
    y, r = F.col("yellows_in_match"), F.col("reds_in_match")
    return (referee_matches(star).groupBy("referee_id", "season_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(r).alias("sr"),
                 F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.min(r).alias("min_r"), F.max(r).alias("max_r")))


def q8a_referees(star: Star) -> DataFrame:
    """Q8A: per referee, card means over season means, their spread and per-match extremes."""
    rs = referee_seasons(star).select(
        "*", (F.col("sy") / F.col("n")).alias("my"), (F.col("sr") / F.col("n")).alias("mr"))
    ro = (rs.groupBy("referee_id")
          .agg(F.sum("n").alias("total_matches"), F.count(F.lit(1)).alias("seasons_covered"),
               F.avg("my").alias("avg_y"), F.stddev_pop("my").alias("sd_y"),
               F.avg("mr").alias("avg_r"), F.stddev_pop("mr").alias("sd_r"),
               F.min("min_y").alias("min_yellows_in_a_match"), F.max("max_y").alias("max_yellows_in_a_match"),
               F.min("min_r").alias("min_reds_in_a_match"), F.max("max_r").alias("max_reds_in_a_match")))
    refs = small_dim(star.referee.select("referee_id", F.col("name").alias("referee_name")))
    return (ro.join(refs, "referee_id")
            .select("referee_name", "total_matches", "seasons_covered",
                    F.round("avg_y", 3).alias("avg_yellow_cards_per_match"),
                    F.round("sd_y", 3).alias("yellow_consistency_stddev"),
                    "min_yellows_in_a_match", "max_yellows_in_a_match",
                    F.round("avg_r", 3).alias("avg_red_cards_per_match"),
                    F.round("sd_r", 3).alias("red_consistency_stddev"),
                    "min_reds_in_a_match", "max_reds_in_a_match")
            .orderBy(F.desc("avg_yellow_cards_per_match"), "referee_name"))


def referee_strictness(star: Star, min_matches: int = MIN_REFEREE_MATCHES) -> DataFrame:
    """Per referee (>= min_matches): weighted card mean and result counts, one aggregation."""
    ftr = F.col("full_time_result")
    weighted = F.col("yellows_in_match") + F.lit(2) * F.col("reds_in_match")
    return (referee_matches(star).groupBy("referee_id")
            .agg(F.count(F.lit(1)).alias("ref_match_count"), F.sum(weighted).alias("sw"),
                 F.count_if(ftr == "H").alias("nh"), F.count_if(ftr == "D").alias("nd"),
                 F.count_if(ftr == "A").alias("na"))
            .where(F.col("ref_match_count") >= min_matches)
            .withColumn("ref_avg_weighted_cards", exact_mean("sw", "ref_match_count")))


def referee_tiles(star: Star, min_matches: int = MIN_REFEREE_MATCHES) -> DataFrame:
    """Referees in card-intensity terciles: one row per referee, so a plain window serves."""
    order = Window.orderBy(F.col("ref_avg_weighted_cards").asc_nulls_first(), "referee_id")
    return referee_strictness(star, min_matches).withColumn("card_intensity_tile", F.ntile(3).over(order))


def q8b_referee_bands(star: Star, min_matches: int = MIN_REFEREE_MATCHES) -> DataFrame:
    """Q8B: match outcomes under low / medium / high card-intensity referees."""
    agg = (referee_tiles(star, min_matches).groupBy("card_intensity_tile")
           .agg(F.sum("ref_match_count").alias("n"), F.sum("nh").alias("nh"),
                F.sum("nd").alias("nd"), F.sum("na").alias("na")))
    return (agg.orderBy("card_intensity_tile")
            .select(band_label("card_intensity_tile", REFEREE_BAND_LABELS).alias("referee_group"),
                    F.col("n").alias("matches"), pct("nh", "n").alias("home_win_pct"),
                    pct("nd", "n").alias("draw_pct"), pct("na", "n").alias("away_win_pct")))


QUESTIONS = {
    "q1_consistency": q1_consistency,
    "q2_expected_points": q2_expected_points,
    "q3_comebacks": q3_comebacks,
    "q4_pressure": q4_pressure,
    "q5_scoring": q5_scoring,
    "q6_bookmaker": q6_bookmaker,
    "q7a_aggression": q7a_aggression,
    "q7b_aggression_bands": q7b_aggression_bands,
    "q8a_referees": q8a_referees,
    "q8b_referee_bands": q8b_referee_bands,
}
