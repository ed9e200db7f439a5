"""Two-sided unpivot of a match into team-perspective rows.

One match becomes two rows (side 'H' with the home columns, side 'A' with the
away columns) through ``inline(array(struct_h, struct_a))``: a single
``Generate`` over one scan, no shuffle and no second pass over the fact, in
place of a UNION ALL of two scans or a disjunctive ``team IN (home, away)``
join (which Spark can only run as a nested-loop join).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.football import AWAY, HOME
from ..functions.numeric import _c

# Home/away column pairs of the match fact, by perspective-neutral name.
SIDE_COLUMNS = {
    "goals_for": ("full_time_home_goals", "full_time_away_goals"),
    "goals_against": ("full_time_away_goals", "full_time_home_goals"),
    "ht_goals_for": ("half_time_home_goals", "half_time_away_goals"),
    "ht_goals_against": ("half_time_away_goals", "half_time_home_goals"),
    "shots": ("home_shots", "away_shots"),
    "shots_on_target": ("home_shots_on_target", "away_shots_on_target"),
    "fouls": ("home_fouls", "away_fouls"),
    "corners": ("home_corners", "away_corners"),
    "yellows": ("home_yellow_cards", "away_yellow_cards"),
    "reds": ("home_red_cards", "away_red_cards"),
    "odds_win": ("home_win_odds", "away_win_odds"),
}


def team_view(match: DataFrame,
              metrics: Mapping[str, tuple] | Sequence[str] = (),
              keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot ``match`` into (keep..., side, team_id, opponent_id, metrics...).

    ``metrics`` maps an output name to a (home expression, away expression)
    pair; a bare name looks the pair up in :data:`SIDE_COLUMNS`.
    Both structs get identical field names and types, as ``array`` requires.
    """
    if not isinstance(metrics, Mapping):
        metrics = {name: SIDE_COLUMNS[name] for name in metrics}

    def side_struct(side: str, idx: int) -> Column:
        fields = [F.lit(side).alias("side"),
                  F.col("home_team_id" if idx == 0 else "away_team_id").alias("team_id"),
                  F.col("away_team_id" if idx == 0 else "home_team_id").alias("opponent_id")]
        fields += [_c(pair[idx]).alias(name) for name, pair in metrics.items()]
        return F.struct(*fields)

    return match.select(*keep, F.inline(F.array(side_struct(HOME, 0), side_struct(AWAY, 1))))
