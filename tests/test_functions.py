"""Hand-computed checks of the column expressions and the traps they guard."""

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from pitchside.functions.football import (aggression, band_label, card_total, confidence_band, expected_points,
                                          favourite, implied_probs, points, pressure_side, strict_least)
from pitchside.functions.numeric import exact_stddev_pop, half_up_ratio, pct


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_points(spark):
    rows = [("H", "H"), ("H", "A"), ("D", "H"), ("D", "A"), ("A", "A"), ("A", "H")]
    got = one(spark, points("r", F.col("s")), "r string, s string", rows)
    assert got == [3, 0, 1, 1, 3, 0]
    # Σ points per match ∈ {2, 3}
    for res in "HDA":
        h, a = one(spark, points("r", "H"), "r string", [(res,)])[0], one(spark, points("r", "A"), "r string", [(res,)])[0]
        assert h + a in (2, 3)


def test_implied_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(Decimal("1.50"), Decimal("4.00"), Decimal("6.50"))], "h decimal(6,2), d decimal(6,2), a decimal(6,2)")
    ph, pd, pa = implied_probs("h", "d", "a")
    r = df.select(ph.alias("ph"), pd.alias("pd"), pa.alias("pa"),
                  expected_points(ph, pd).alias("eh"), expected_points(pa, pd).alias("ea")).first()
    assert math.isclose(r.ph + r.pd + r.pa, 1.0, rel_tol=1e-12)
    assert 2.0 <= r.eh + r.ea <= 3.0


def test_favourite_ties_and_nulls(spark):
    sch = "h decimal(6,2), d decimal(6,2), a decimal(6,2)"
    rows = [(Decimal("2.00"), Decimal("2.00"), Decimal("2.00")),   # tie -> H
            (Decimal("3.00"), Decimal("2.00"), Decimal("2.00")),   # D before A
            (Decimal("3.00"), Decimal("4.00"), Decimal("2.00")),
            (None, Decimal("2.00"), Decimal("3.00"))]              # any NULL -> A (N3)
    assert one(spark, favourite("h", "d", "a"), sch, rows) == ["H", "D", "A", "A"]


def test_confidence_band_strict_least(spark):
    sch = "h decimal(6,2), d decimal(6,2), a decimal(6,2)"
    rows = [(Decimal("1.60"), Decimal("3.00"), Decimal("5.00")),
            (Decimal("2.20"), Decimal("3.00"), Decimal("5.00")),
            (Decimal("2.21"), Decimal("3.00"), Decimal("5.00")),
            (None, Decimal("1.10"), Decimal("5.00"))]              # NULL least -> low (N2)
    assert one(spark, confidence_band(strict_least("h", "d", "a")), sch, rows) == ["high", "medium", "low", "low"]


def test_pressure_side_nulls(spark):
    rows = [(5, 3), (3, 5), (4, 4), (None, 2)]
    assert one(spark, pressure_side("h", "a"), "h int, a int", rows) == ["H", "A", "T", "T"]   # N7


def test_aggression_null_propagates_cards_do_not(spark):
    rows = [(10, 2, 1), (10, None, 0)]
    assert one(spark, aggression("f", "y", "r"), "f int, y int, r int", rows) == [26, None]   # N8
    rows = [(2, None), (None, None)]
    assert one(spark, card_total("h", "a"), "h int, a int", rows) == [2, 0]
    assert one(spark, card_total("h", "a", weight=2), "h int, a int", [(1, 1)]) == [4]


def test_band_label(spark):
    labels = ("low", "mid", "high")
    assert one(spark, band_label("t", labels), "t int", [(1,), (3,), (4,)]) == ["low", "high", None]


def test_half_up_ratio_exact(spark):
    # 2.675 is 2675/1000 exactly: half up -> 2.68 (binary rounding of the double would give 2.67)
    rows = [(2675, 1000), (-2675, 1000), (1, 3), (2, 3), (5, 0), (811, 400)]
    got = one(spark, half_up_ratio("n", "d", 2), "n long, d long", rows)
    assert got == [2.68, -2.68, 0.33, 0.67, None, 2.03]
    assert one(spark, pct("n", "d"), "n long, d long", [(1, 8)]) == [12.5]


def test_exact_stddev_pop_matches_numpy(spark):
    xs = [81, 77, 95, 60, 88]
    n, s, ss = len(xs), sum(xs), sum(x * x for x in xs)
    got = spark.range(1).select(exact_stddev_pop(F.lit(n), F.lit(s), F.lit(ss))).first()[0]
    assert math.isclose(got, float(np.std(xs)), rel_tol=1e-12)   # population, not sample (N1)
