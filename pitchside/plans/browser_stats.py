"""Statistics the reference computed in the browser, as Spark jobs.

They run on question results, which hold one row per team, season or
referee, so their windows without PARTITION BY are bounded by those counts,
never by the fact. Medians and the trend line work on the integer-scaled
values of already rounded inputs (2- or 3-place decimals), so sums and
interpolations are exact and independent of row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.star import Star
from .questions import (q2_expected_points, q3_comebacks, q4_pressure, q5_scoring, q6_bookmaker, q7a_aggression,
                        q8a_referees)
from .transforms import t2_season_points

# Fixed values of the reference's charts: quadrant names, loss-class names and
# limits, bubble radius bounds, preview size and series labels.
ZONE_LABELS = {
    (True, True): "Clinical converters (high win, low loss)",
    (True, False): "Chaotic dominance (high win, high loss)",
    (False, True): "Passive control (low win, low loss)",
    (False, False): "Wasteful pressure (low win, high loss)",
}
LOSS_CLASSES = (("Wasteful", 25), ("Average", 15))
LOSS_CLASS_DEFAULT = "Clinical"
RADIUS_MIN, RADIUS_MAX, RADIUS_SCALE = 6.0, 22.0, 1.6
PREVIEW_ROWS = 50
Q5_SERIES = (("Avg Total Goals", "avg_total_goals"), ("Avg Home Goals", "avg_home_goals"),
             ("Avg Away Goals", "avg_away_goals"))
Q6_SERIES = (("Overall Accuracy %", "overall_prediction_accuracy_pct"),
             ("Med-Confidence Accuracy %", "medium_confidence_accuracy_pct"))

def _all():
    """Window over a whole (small) question result."""
    return Window.partitionBy()


def _scaled(col: str, places: int):
    return F.round(F.col(col) * F.lit(10 ** places)).cast("long")


def p1_quadrants(star: Star) -> DataFrame:
    """Q4 teams placed in quadrants around the median win and loss rates."""
    win, loss = "win_rate_with_pressure_pct", "loss_rate_despite_pressure_pct"
    q4 = q4_pressure(star)
    med_w = F.median(_scaled(win, 2)).over(_all()) / F.lit(100.0)
    med_l = F.median(_scaled(loss, 2)).over(_all()) / F.lit(100.0)
    df = q4.select("team_name", win, loss, med_w.alias("median_win_rate_pct"), med_l.alias("median_loss_rate_pct"))
    good_w = F.coalesce(F.col(win), F.lit(0.0)) >= F.col("median_win_rate_pct")
    good_l = F.coalesce(F.col(loss), F.lit(0.0)) <= F.col("median_loss_rate_pct")
    zone = (F.when(good_w & good_l, ZONE_LABELS[(True, True)])
            .when(good_w, ZONE_LABELS[(True, False)])
            .when(good_l, ZONE_LABELS[(False, True)])
            .otherwise(ZONE_LABELS[(False, False)]))
    return df.withColumn("zone", zone)


def loss_class(loss_col) -> F.Column:
    """P2 rule: loss rate above 25 Wasteful, above 15 Average, else Clinical."""
    c = F.coalesce(F.col(loss_col), F.lit(0.0))
    expr = None
    for name, limit in LOSS_CLASSES:
        expr = F.when(c > limit, name) if expr is None else expr.when(c > limit, name)
    return expr.otherwise(LOSS_CLASS_DEFAULT)


def p2_loss_class(star: Star) -> DataFrame:
    """Loss class of each Q4 team."""
    return q4_pressure(star).select("team_name", "loss_rate_despite_pressure_pct",
                                    loss_class("loss_rate_despite_pressure_pct").alias("loss_class"))


def p3_trend(star: Star) -> DataFrame:
    """Least-squares line of points per match on aggression index over the Q7A teams.

    x has 2 decimal places and y 3, so sums run on x*100 and y*1000 as exact
    integers. A constant x gives slope 0 and intercept mean(y); a missing x or y counts as 0.
    """
    q = q7a_aggression(star).na.fill(0.0, ["avg_aggression_index", "avg_points_per_match"])
    x, y = _scaled("avg_aggression_index", 2), _scaled("avg_points_per_match", 3)
    s = q.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
              F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"),
              F.min("avg_aggression_index").alias("min_x"), F.max("avg_aggression_index").alias("max_x"))
    n, sx, sy, sxy, sxx = (F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx"))
    num = n * sxy - sx * sy
    den = n * sxx - sx * sx
    slope = F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double") / F.lit(10.0))
    intercept = (sy.cast("double") / F.lit(1000.0) - F.col("slope") * (sx.cast("double") / F.lit(100.0))) / n.cast("double")
    return (s.where(n > 0).withColumn("slope", slope).withColumn("intercept", intercept)
            .select("n", "slope", "intercept", "min_x", "max_x",
                    (F.col("slope") * F.col("min_x") + F.col("intercept")).alias("y_at_min_x"),
                    (F.col("slope") * F.col("max_x") + F.col("intercept")).alias("y_at_max_x")))


def p4_outcome_split(star: Star) -> DataFrame:
    """Win / draw / loss shares of half-time comebacks (Q3), loss as 100 - non-loss."""
    w = F.coalesce(F.col("win_comeback_pct"), F.lit(0.0))
    d = F.coalesce(F.col("draw_comeback_pct"), F.lit(0.0))
    nl = F.coalesce(F.nullif(F.col("non_loss_comeback_pct"), F.lit(0.0)), w + d)
    return (q3_comebacks(star)
            .select("team_name", w.alias("win_pct"), d.alias("draw_pct"), nl.alias("non_loss_pct"))
            .withColumn("loss_pct", F.greatest(F.lit(0.0), F.lit(100.0) - F.col("non_loss_pct")))
            .orderBy(F.desc("non_loss_pct"), "team_name"))


def p5_size(star: Star) -> DataFrame:
    """P5: bubble size of each Q4 team, clamped between 6 and 22."""
    m = F.greatest(F.lit(1), F.coalesce(F.col("matches_with_pressure"), F.lit(1))).cast("double")
    r = F.greatest(F.lit(RADIUS_MIN), F.least(F.lit(RADIUS_MAX), F.sqrt(m) * F.lit(RADIUS_SCALE)))
    return q4_pressure(star).select("team_name", "matches_with_pressure", r.alias("bubble_radius"))


def preview(df: DataFrame, order_cols: list, rows: int = PREVIEW_ROWS) -> DataFrame:
    """First ``rows`` rows numbered from 1, with the total and hidden counts.

    The job runs once: its rows are written to the shared folder and counted as they are
    written. ``orderBy().limit()`` on them plans as a bounded top-k; the numbering window runs
    on at most ``rows`` rows.
    """
    seen, path = Observation(), scratch_path(df.sparkSession, "preview")
    df.observe(seen, F.count(F.lit(1)).alias("total")).write.parquet(path)
    total = seen.get["total"]
    top = df.sparkSession.read.schema(df.schema).parquet(path).orderBy(*order_cols).limit(rows)
    numbered = top.withColumn("row_no", F.row_number().over(Window.orderBy(*order_cols)).cast("long"))
    return numbered.select("row_no", *df.columns, F.lit(total).cast("long").alias("total_rows"),
                           F.lit(max(0, total - rows)).cast("long").alias("hidden_rows"))


def p6_preview(star: Star) -> DataFrame:
    """Numbered first 50 rows of the per-team season points, with total and hidden counts."""
    return preview(t2_season_points(star), ["team_name", "season_name"])


def p7_series(star: Star) -> DataFrame:
    """Q5 and Q6 season metrics laid out as labelled series."""
    def series(df, pairs):
        cols = [F.col(c).cast("double").alias(label) for label, c in pairs]
        return df.select("season_name", *cols).unpivot(["season_name"], [label for label, _ in pairs],
                                                        "series", "value")
    out = series(q5_scoring(star), Q5_SERIES).unionByName(series(q6_bookmaker(star), Q6_SERIES))
    return out.orderBy("series", "season_name")          # seasons ascending within each series


def to_number(col: str):
    """NULL or non-numeric -> 0 (presentation only)."""
    v = F.col(col).try_cast("double")
    return F.when(F.isnan(v) | v.isNull() | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(v)


def p9_numeric_coercion(star: Star) -> DataFrame:
    """Q6 values with NULL / non-numeric / infinite turned into 0 for charting."""
    q6 = q6_bookmaker(star)
    return q6.select("season_name", *[to_number(c).alias(c) for c in q6.columns if c != "season_name"])


def p10_ranked(star: Star) -> DataFrame:
    """P10: Q2 teams ranked by points over expectation per game."""
    q2 = q2_expected_points(star)
    key = F.coalesce(F.col("points_over_expected_per_game"), F.lit(0.0))
    return q2.select("team_name", "points_over_expected_per_game", "avg_actual_points_per_game",
                     "avg_expected_points_per_game",
                     F.row_number().over(Window.orderBy(key.desc(), F.col("team_name"))).cast("long").alias("chart_rank"))


def p10_ranked_referees(star: Star) -> DataFrame:
    """P10: Q8A referees ranked by yellow cards per match (highest first)."""
    q8a = q8a_referees(star)
    key = F.coalesce(F.col("avg_yellow_cards_per_match"), F.lit(0.0))
    return q8a.select("referee_name", "avg_yellow_cards_per_match", "avg_red_cards_per_match",
                      F.row_number().over(Window.orderBy(key.desc(), F.col("referee_name"))).cast("long").alias("chart_rank"))


BROWSER_STATS = {
    "p1_quadrants": p1_quadrants,
    "p2_loss_class": p2_loss_class,
    "p3_trend": p3_trend,
    "p4_outcome_split": p4_outcome_split,
    "p5_size": p5_size,
    "p6_preview": p6_preview,
    "p7_series": p7_series,
    "p9_numeric_coercion": p9_numeric_coercion,
    "p10_ranked": p10_ranked,
    "p10_ranked_referees": p10_ranked_referees,
}
