"""Question-level traps on a hand-built star schema of a few matches."""

import datetime as dt
from decimal import Decimal as D

import pytest

from pitchside.plans.browser_stats import p3_trend
from pitchside.plans.questions import (q1_consistency, q2_expected_points, q3_comebacks, q6_bookmaker,
                                       q8a_referees, q8b_referee_bands)
from pitchside.sources.star import Star

MATCH_SCHEMA = ("match_id long, league_id long, season_id long, match_date date, home_team_id long, "
                "away_team_id long, full_time_home_goals int, full_time_away_goals int, full_time_result string, "
                "half_time_home_goals int, half_time_away_goals int, half_time_result string, referee_id long, "
                "home_shots int, away_shots int, home_shots_on_target int, away_shots_on_target int, "
                "home_fouls int, away_fouls int, home_corners int, away_corners int, home_yellow_cards int, "
                "away_yellow_cards int, home_red_cards int, away_red_cards int, original_div_code string")


def m(mid, season, home, away, fh, fa, hh, ha, htr, ref, hy=1, ay=1, hr=0, ar=0, hsot=5, asot=3):
    ftr = "H" if fh > fa else ("A" if fh < fa else "D")
    return (mid, 1, season, dt.date(2000 + season, 1, 1), home, away, fh, fa, ftr, hh, ha, htr, ref,
            10, 8, hsot, asot, 10, 12, 4, 3, hy, ay, hr, ar, "E0")


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [
        m(1, 1, 1, 2, 2, 1, 0, 1, "A", 1),     # home trailed at HT and won
        m(2, 1, 2, 1, 1, 1, 1, 0, "H", 1, ay=None),
        m(3, 2, 1, 2, 0, 3, 0, 0, "D", 2, hy=3, hr=1),
        m(4, 2, 2, 1, 2, 2, 2, 0, "H", 2),     # away trailed at HT, drew
        m(5, 2, 1, 2, 1, 0, 0, 0, "D", None),  # no referee
        m(6, 1, 1, 2, 0, 0, 0, 0, "D", 2),
    ]
    match = spark.createDataFrame(rows, MATCH_SCHEMA)
    odds = spark.createDataFrame([
        (1, 1, D("1.50"), D("4.00"), D("6.00")),
        (2, 1, None, D("3.00"), D("2.00")),        # NULL odds: predicted 'A', band low, still counted in Q6
        (3, 1, D("2.00"), D("3.00"), D("4.00")),
        (4, 1, D("0.00"), D("3.00"), D("2.00")),   # zero odds: excluded by Q2 only
        (5, 1, D("2.10"), D("3.10"), D("3.50")),
        (6, 1, D("3.00"), D("3.00"), D("2.50")),
    ], "match_id long, bookmaker_id long, home_win_odds decimal(6,2), draw_odds decimal(6,2), away_win_odds decimal(6,2)")
    team = spark.createDataFrame([(1, "Alpha", None), (2, "Beta", None)], "team_id long, name string, short_name string")
    season = spark.createDataFrame([(1, "2001-2002", 2001, 2002), (2, "2002-2003", 2002, 2003)],
                                   "season_id long, name string, start_year short, end_year short")
    referee = spark.createDataFrame([(1, "R One"), (2, "R Two")], "referee_id long, name string")
    league = spark.createDataFrame([(1, "E0", "Premier League", "England")], "league_id long, code string, name string, country string")
    bookmaker = spark.createDataFrame([(1, "B365", "Bet365")], "bookmaker_id long, code string, name string")
    return Star(league=league, season=season, team=team, referee=referee, bookmaker=bookmaker,
                match=match, match_odds=odds)


def test_q1_population_stddev(tiny):
    rows = {r.team_name: r for r in q1_consistency(tiny, seasons=2).collect()}
    # Alpha: season 1 -> 3 (m1) + 1 (m2) + 1 (m6) = 5 ; season 2 -> 0 (m3) + 1 (m4) + 3 (m5) = 4
    assert rows["Alpha"].avg_points == 4.5
    assert rows["Alpha"].variation == 0.5                  # population stddev of (5, 4); sample would be 0.707
    assert rows["Alpha"].consistency_score == 4.5 / 1.5


def test_q2_excludes_null_and_zero_odds(tiny):
    r = {x.team_name: x for x in q2_expected_points(tiny, seasons=2).collect()}
    assert r["Alpha"].matches_considered == 4              # matches 1, 3, 5, 6


def test_q3_comebacks(tiny):
    r = {x.team_name: x for x in q3_comebacks(tiny, min_games=1).collect()}
    # Alpha trails at HT in m1 (home, won), m2 and m4 (away, both drawn); Beta never trails
    a = r["Alpha"]
    assert (a.losing_ht_games, a.full_comebacks_to_win, a.comebacks_to_draw, a.comebacks_to_non_loss) == (3, 1, 2, 3)
    assert (a.win_comeback_pct, a.draw_comeback_pct, a.non_loss_comeback_pct) == (33.33, 66.67, 100.0)
    assert "Beta" not in r


def test_q6_null_odds_counted_and_deltas_on_rounded(tiny):
    rows = q6_bookmaker(tiny).collect()
    s1 = rows[0]
    # season 1: matches 1 (pred H, actual H), 2 (NULL -> pred A, actual D), 6 (pred A, actual D)
    assert s1.overall_prediction_accuracy_pct == 33.33
    assert s1.overall_accuracy_change_pp is None
    s2 = rows[1]
    assert s2.overall_accuracy_change_pp == round(s2.overall_prediction_accuracy_pct - 33.33, 2)


def test_q8a_unweighted_season_means(tiny):
    r = {x.referee_name: x for x in q8a_referees(tiny).collect()}
    # R One: season 1 only, yellows 2 and 1 (NULL -> 0) -> mean 1.5
    assert r["R One"].avg_yellow_cards_per_match == 1.5
    assert r["R One"].seasons_covered == 1
    # R Two: season 1 (m6: 2 yellows) and season 2 (m3: 4, m4: 2) -> mean of (2, 3) = 2.5
    assert r["R Two"].avg_yellow_cards_per_match == 2.5
    assert r["R Two"].yellow_consistency_stddev == 0.5


def test_q8b_bands(tiny):
    rows = q8b_referee_bands(tiny, min_matches=1).collect()
    assert [r.referee_group for r in rows] == ["LOW_CARD_REFEREES", "MEDIUM_CARD_REFEREES"]
    assert sum(r.matches for r in rows) == 5               # the match without referee is not labelled


def test_trend_constant_x(spark, tiny, monkeypatch):
    import pitchside.plans.browser_stats as bs
    fake = spark.createDataFrame([("A", 10.0, 1.0), ("B", 10.0, 2.0)],
                                 "team_name string, avg_aggression_index double, avg_points_per_match double")
    monkeypatch.setattr(bs, "q7a_aggression", lambda star: fake)
    r = p3_trend(tiny).first()
    assert r.slope == 0.0 and r.intercept == 1.5           # slope 0 and mean(y) when x is constant


def test_catalog(tiny):
    from pitchside.plans.catalog import CATALOG, QuestionNotFound, run_question
    assert [c.id for c in CATALOG] == [str(i) for i in range(1, 9)]
    parts = run_question(tiny, "8")
    assert set(parts) == {"A", "B"}
    with pytest.raises(QuestionNotFound):
        run_question(tiny, "99")


def test_q6_counts_every_bookmaker_q2_only_b365(spark, tiny):
    from dataclasses import replace
    other = spark.createDataFrame([(1, 2, D("9.00"), D("1.20"), D("9.00"))],
                                  "match_id long, bookmaker_id long, home_win_odds decimal(6,2), "
                                  "draw_odds decimal(6,2), away_win_odds decimal(6,2)")
    books = spark.createDataFrame([(1, "B365", "Bet365"), (2, "XX", "Other")], "bookmaker_id long, code string, name string")
    two = replace(tiny, match_odds=tiny.match_odds.unionByName(other), bookmaker=books)
    q6_one = {r.season_name: r for r in q6_bookmaker(tiny).collect()}
    q6_two = {r.season_name: r for r in q6_bookmaker(two).collect()}
    # season 1 gains one prediction row (the other bookmaker picks D for match 1, actual H): 1 of 4 right
    assert q6_one["2001-2002"].overall_prediction_accuracy_pct == 33.33
    assert q6_two["2001-2002"].overall_prediction_accuracy_pct == 25.0
    q2_one = {r.team_name: r.matches_considered for r in q2_expected_points(tiny, seasons=2).collect()}
    q2_two = {r.team_name: r.matches_considered for r in q2_expected_points(two, seasons=2).collect()}
    assert q2_one == q2_two                                  # Q2 reads B365 only (N4)


def test_audit_flags_home_equals_away(spark, tiny):
    from dataclasses import replace
    from pyspark.sql import functions as F
    from pitchside.operators.audit import audit
    same = tiny.match.withColumn("away_team_id", F.when(F.col("match_id") == 1, F.lit(1)).otherwise(F.col("away_team_id")))
    v = {r.rule: r.violations for r in audit(replace(tiny, match=same)).collect()}
    assert v["check match.home_team_id <> away_team_id"] == 1   # T1 would count it twice (N11)
