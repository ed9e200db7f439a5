"""Column expressions for match facts.

All of them are plain Catalyst expressions: they stay inside whole-stage
codegen and cost nothing beyond the scan that feeds them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import _c

# Fixed values shared with the reference's semantics: result codes, league
# points per outcome, confidence-band odds limits and band labels.
HOME, DRAW, AWAY = "H", "D", "A"
RESULTS = (HOME, DRAW, AWAY)
WIN_POINTS, DRAW_POINTS, LOSS_POINTS = 3, 1, 0
HIGH_CONFIDENCE_MAX_ODDS = "1.60"
MEDIUM_CONFIDENCE_MAX_ODDS = "2.20"
AGGRESSION_BAND_LABELS = ("Low aggression", "Medium aggression", "High aggression")
REFEREE_BAND_LABELS = ("LOW_CARD_REFEREES", "MEDIUM_CARD_REFEREES", "HIGH_CARD_REFEREES")


def result_of(home_goals, away_goals) -> Column:
    """'H', 'A' or 'D' by comparing two goal counts (NULL if either is NULL)."""
    h, a = _c(home_goals), _c(away_goals)
    return F.when(h > a, F.lit(HOME)).when(h < a, F.lit(AWAY)).when(h == a, F.lit(DRAW))


def points(result, side) -> Column:
    """League points of ``side`` ('H'/'A' literal or column) for a full-time result."""
    r = _c(result)
    s = F.lit(side) if isinstance(side, str) and side in RESULTS else _c(side)
    return (F.when(r == s, F.lit(WIN_POINTS))
            .when(r == F.lit(DRAW), F.lit(DRAW_POINTS))
            .otherwise(F.lit(LOSS_POINTS)))


def inverse_odds(odds) -> Column:
    """1 / odds as DOUBLE (odds are DECIMAL(6,2); the caller has excluded 0 and NULL)."""
    return F.lit(1.0) / _c(odds).cast("double")


def implied_probs(home_odds, draw_odds, away_odds) -> tuple[Column, Column, Column]:
    """Bookmaker-margin-free outcome probabilities (p_home, p_draw, p_away)."""
    ih, idr, ia = inverse_odds(home_odds), inverse_odds(draw_odds), inverse_odds(away_odds)
    total = ih + idr + ia
    return ih / total, idr / total, ia / total


def expected_points(p_win, p_draw) -> Column:
    """T4: 3 * p_win + 1 * p_draw."""
    return F.lit(float(WIN_POINTS)) * _c(p_win) + F.lit(float(DRAW_POINTS)) * _c(p_draw)


# Parts of a point that sums of expected points count in: whole numbers add up to the same sum in any order.
POINT_PARTS = 10 ** 12


def point_parts(points_col) -> Column:
    """Expected points in whole parts of a point, to be summed."""
    return F.floor(_c(points_col) * F.lit(float(POINT_PARTS)) + F.lit(0.5)).cast("decimal(19,0)")


def from_parts(total) -> Column:
    """A sum of parts, in points."""
    return _c(total).cast("double") / F.lit(float(POINT_PARTS))


def sql_sum_points(expr: str) -> str:
    """SQL text of the sum of expected points, added up in whole parts."""
    return f"(CAST(SUM(CAST(floor(({expr}) * CAST(1e12 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / CAST(1e12 AS DOUBLE))"


def favourite(home_odds, draw_odds, away_odds) -> Column:
    """T5: outcome with the lowest odds; ties go H, then D; any NULL comparison falls to 'A'."""
    h, d, a = _c(home_odds), _c(draw_odds), _c(away_odds)
    return (F.when((h <= d) & (h <= a), F.lit(HOME))
            .when((d <= h) & (d <= a), F.lit(DRAW))
            .otherwise(F.lit(AWAY)))


def strict_least(*cols) -> Column:
    """LEAST that is NULL when any argument is NULL (Spark's ``least`` skips NULLs)."""
    cs = [_c(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(any_null, F.lit(None)).otherwise(F.least(*cs))


def confidence_band(min_odds) -> Column:
    """T6: 'high' up to 1.60, 'medium' up to 2.20, else (and NULL) 'low'."""
    from decimal import Decimal
    m = _c(min_odds)
    return (F.when(m <= F.lit(Decimal(HIGH_CONFIDENCE_MAX_ODDS)), F.lit("high"))
            .when(m <= F.lit(Decimal(MEDIUM_CONFIDENCE_MAX_ODDS)), F.lit("medium"))
            .otherwise(F.lit("low")))


def pressure_side(home_sot, away_sot) -> Column:
    """Side with strictly more shots on target; tie or NULL gives 'T'."""
    h, a = _c(home_sot), _c(away_sot)
    return F.when(h > a, F.lit(HOME)).when(a > h, F.lit(AWAY)).otherwise(F.lit("T"))


def aggression(fouls, yellows, reds) -> Column:
    """Fouls + 3*yellow + 10*red; NULL if any part is NULL."""
    return _c(fouls) + F.lit(3) * _c(yellows) + F.lit(10) * _c(reds)


def card_total(home, away, weight: int = 1) -> Column:
    """NULL-as-zero sum of one card colour over both sides, times ``weight``."""
    s = F.coalesce(_c(home), F.lit(0)) + F.coalesce(_c(away), F.lit(0))
    return s if weight == 1 else F.lit(weight) * s


def band_label(tile, labels) -> Column:
    """1-based tile number to its label (NULL outside the label list)."""
    t = _c(tile)
    expr = None
    for i, label in enumerate(labels, start=1):
        expr = F.when(t == i, F.lit(label)) if expr is None else expr.when(t == i, F.lit(label))
    return expr
