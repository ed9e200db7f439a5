"""The conformed star schema every question job reads.

``match`` is the fact (one row per match); ``match_odds`` extends it per
bookmaker; the rest are small dimensions. Two physical forms exist:

* a lazily derived star (``sources.fixtures``) whose odds come from the same
  source rows as the match, so :meth:`Star.matches_with_odds` needs no join;
* a stored star (``plans.ingest_star.write_star``, the loader, :func:`read_star`),
  where a match row holds its odds, one entry per bookmaker: ``match`` and
  ``match_odds`` are two views of one table, and bringing them together again
  is no join (the columns that a question does not read are pruned, inside the
  entries too).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Snapshot, current, read_parts, table_path

STAR_TABLES = ("league", "season", "team", "referee", "bookmaker", "match", "match_odds")
ODDS_COLUMNS = ("home_win_odds", "draw_odds", "away_win_odds")
_SIDES = ("shots", "shots_on_target", "fouls", "corners", "yellow_cards", "red_cards")
FACTS = ("match", "match_odds")
FACT_SCHEMAS = {
    "match": (
        "match_id string", "league_id long", "season_id long", "match_date date", "home_team_id long", "away_team_id long",
        "full_time_home_goals int", "full_time_away_goals int", "full_time_result string", "half_time_home_goals int",
        "half_time_away_goals int", "half_time_result string", "referee_id long",
        *[f"{side}_{what} int" for what in _SIDES for side in ("home", "away")], "original_div_code string"),
}
ODDS_ENTRY = ("bookmaker_id", *ODDS_COLUMNS)
_ODDS = "odds array<struct<bookmaker_id: bigint, " + ", ".join(f"{c}: decimal(6,2)" for c in ODDS_COLUMNS) + ">>"
MATCH_COLUMNS = tuple(c.split()[0] for c in FACT_SCHEMAS["match"])


@dataclass
class Star:
    league: DataFrame
    season: DataFrame
    team: DataFrame
    referee: DataFrame
    bookmaker: DataFrame
    match: DataFrame
    match_odds: DataFrame
    # Match rows that already carry (bookmaker_id, odds), one row per match and
    # bookmaker; set only when match and odds are two projections of one input.
    odds_aligned: DataFrame | None = None

    def matches_with_odds(self, bookmaker_code: str | None = None) -> DataFrame:
        """``match ⋈ match_odds`` (restricted to one bookmaker code when given)."""
        if self.odds_aligned is not None:
            joined = self.odds_aligned
        else:
            joined = self.match.join(self.match_odds, "match_id")
        if bookmaker_code is None:
            return joined
        # The code is a unique key of a small dimension: look its id up (at most two rows
        # read, to prove uniqueness) and filter on it, a predicate the scan can push down.
        rows = self.bookmaker.where(F.col("code") == bookmaker_code).select("bookmaker_id").limit(2).collect()
        if len(rows) > 1:
            raise ValueError(f"bookmaker code {bookmaker_code!r} is not unique")
        if not rows:
            return joined.where(F.lit(False))
        return joined.where(F.col("bookmaker_id") == F.lit(rows[0][0]))

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in STAR_TABLES}


def read_matches(spark: SparkSession, root: str, held: Snapshot) -> DataFrame:
    """The stored matches: their live rows with their odds, and the file and the commit they come from."""
    return read_parts(spark, root, "match", held.facts, ", ".join([*FACT_SCHEMAS["match"], _ODDS, "file_id string", "commit string"]))


def read_star(spark: SparkSession, root: str, held: Snapshot | None = None) -> Star:
    """Open the current (or the given) version of a star written by the loader or ``write_star``."""
    held = held or current(spark, root)
    if held is None:
        raise FileNotFoundError(f"no star at {root}")
    tables = {name: spark.read.parquet(table_path(root, name, held.tables[name])) for name in STAR_TABLES if name not in FACTS}
    rows = read_matches(spark, root, held)
    return Star(match=rows.select(*MATCH_COLUMNS), match_odds=rows.select("match_id", F.inline("odds")),
                odds_aligned=rows.select(*MATCH_COLUMNS, F.inline("odds")), **tables)


def star_exists(spark: SparkSession, root: str) -> bool:
    return current(spark, root) is not None


def register_star_views(star: Star, prefix: str = "") -> list[str]:
    """Expose the star's tables as temporary views (``match``, ``team``, ...) for ``spark.sql``.

    SQL written for the reference's database runs with Spark's dialect: use
    ``stddev_pop`` for its STDDEV and ``count_if`` / ``avg(cast(x AS INT))`` for
    sums and averages of comparisons.
    """
    names = []
    for name, df in star.tables().items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
