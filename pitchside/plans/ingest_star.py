"""Write, refresh and cut a stored star (I10: re-runnable load of the conformed tables).

Every write is a new version of the star (``sources.store``): folders of its own, then one pointer.
Matches are stored with their odds, by league, season and file, so one file, one season or one league is replaced
without touching the folders of the others, and a deleted match takes its odds with it. Rows are sorted by those columns inside each task
before the write, so every task writes one file per part it holds, whatever the data size; no
repartition funnels a season into one task.

The ledger is the table of arrived files: one row per league and full path, with the digest of the
content that arrived last, and the commits that hold its match rows and its quarantined rows.

With ``buckets``, ``match`` and ``match_odds`` are also bucketed (and sorted)
by ``match_id`` into the same number of buckets and registered as tables, so
the fact-to-fact join of the odds questions (Q2, Q6) is a sort-merge join with
no exchange on either side. The load pays one shuffle by ``match_id`` (a
unique key, so no skew) to write exactly one file per bucket and season.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.star import FACTS, MATCH_COLUMNS, ODDS_ENTRY, STAR_TABLES, Star, read_matches
from ..sources.store import PARTS, Snapshot, buried, current, new_commit, publish, read_parts, table_path, write_table

DIMENSIONS = tuple(t for t in STAR_TABLES if t not in FACTS)
LEDGER = "files"
REJECTED = "rejected"
LEDGER_SCHEMA = ("league_id long, league_code string, path string, name string, namesake int, file_id string, digest string, "
                 "season_id long, lines long, state string, reason string, facts string, rejects string")


def read_ledger(spark: SparkSession, root: str, held: Snapshot | None = None) -> DataFrame:
    """The arrived files of the current (or the given) version."""
    held = held or current(spark, root)
    if held is None:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(table_path(root, LEDGER, held.tables[LEDGER]))


def read_rejected(spark: SparkSession, root: str, held: Snapshot | None = None) -> DataFrame:
    """Quarantined rows and files with their reasons."""
    from .ingest import REJECTED_SCHEMA
    held = held or current(spark, root)
    if held is None:
        raise FileNotFoundError(f"no star at {root}")
    return read_parts(spark, root, REJECTED, held.rejects, f"{REJECTED_SCHEMA}, file_id string, commit string").drop("commit")


def with_odds(star: Star, one_price: bool = False) -> DataFrame:
    """Match rows with their odds as entries, as they are stored. Odds without a match, which the schema forbids, have no place.

    ``one_price`` says that ``match`` and ``match_odds`` are projections of ``odds_aligned``, which has one row per match;
    otherwise the odds are grouped by match (a few bookmakers each).
    """
    entry = F.struct(*ODDS_ENTRY)
    if one_price:
        return star.odds_aligned.select(*MATCH_COLUMNS, F.array(entry).alias("odds"))
    prices = star.match_odds.groupBy("match_id").agg(F.collect_list(entry).alias("odds"))
    return star.match.select(*MATCH_COLUMNS).join(prices, "match_id", "left")


def _season_file():
    """Rows that came from no file count as one file per league and season."""
    return F.concat(F.lit("season-"), F.col("league_id").cast("string"), F.lit("-"), F.col("season_id").cast("string"))


def publish_star(spark: SparkSession, root: str, base: Snapshot | None, commit: str, dims: Mapping[str, DataFrame] | None, ledger: DataFrame,
                 facts: Mapping[str, Sequence[str]], rejects: Mapping[str, Sequence[str]]) -> Snapshot:
    """Write the dimensions (None: as they are) and the ledger, then make all of it the next version.

    Commits that no file of the ledger points at any more are left out.
    """
    tables = dict(base.tables) if base else {}
    for name, df in (dims or {}).items():
        write_table(df, root, name, commit)
        tables[name] = commit
    write_table(ledger, root, LEDGER, commit)
    tables[LEDGER] = commit
    # As many rows as there are commits.
    written = spark.read.schema(LEDGER_SCHEMA).parquet(table_path(root, LEDGER, commit))
    live = {k: {r[0] for r in written.select(k).where(F.col(k).isNotNull()).distinct().collect()} for k in ("facts", "rejects")}
    return publish(spark, root, base, tables, {k: v for k, v in facts.items() if k in live["facts"]}, {k: v for k, v in rejects.items() if k in live["rejects"]})


def write_star(star: Star, root: str, one_price: bool = False) -> Snapshot:
    """Write every table of ``star`` as the next version; what stood there before is no part of it."""
    spark = star.match.sparkSession
    base, commit = current(spark, root), new_commit()
    write_table(with_odds(star, one_price).withColumn("file_id", _season_file()), root, "match", commit, PARTS)
    fresh = Snapshot(facts={commit: []})
    return publish_star(spark, root, base, commit, {name: getattr(star, name) for name in DIMENSIONS},
                        _own_files(read_matches(spark, root, fresh), star.league, commit), fresh.facts, {})


def _own_files(match: DataFrame, league: DataFrame, commit: str) -> DataFrame:
    """Ledger rows for the rows of a commit that came from no file: one per league and season."""
    parts = match.groupBy(*PARTS).agg(F.count(F.lit(1)).alias("lines"))
    named = parts.join(league.select("league_id", F.col("code").alias("league_code")), "league_id", "left")
    given = {"name": F.col("file_id"), "namesake": F.lit(0), "state": F.lit("loaded"), "facts": F.lit(commit)}
    return named.select(*[given.get(c.name, F.col(c.name) if c.name in named.columns else F.lit(None)).cast(c.dataType).alias(c.name)
                          for c in _ledger_fields()])


def _ledger_fields():
    from pyspark.sql.types import StructType
    return StructType.fromDDL(LEDGER_SCHEMA).fields


def reload_season(spark: SparkSession, star: Star, root: str, season_id: int) -> Snapshot:
    """Replace one season of match and odds, as ``star`` has it; the folders of the other seasons stay as they are."""
    base, commit = _current(spark, root), new_commit()
    ledger = read_ledger(spark, root, base)
    season = F.col("season_id") == season_id
    write_table(with_odds(star).where(season).withColumn("file_id", _season_file()), root, "match", commit, PARTS)
    # The files of one season.
    dead = [tuple(r) for r in ledger.where(season & F.col("facts").isNotNull()).select("facts", "file_id").collect()]
    own = _own_files(read_matches(spark, root, Snapshot(facts={commit: []})), star.league, commit)
    left = ledger.where(~F.coalesce(season, F.lit(False)))
    return publish_star(spark, root, base, commit, None, left.unionByName(own), buried({**base.facts, commit: []}, dead), base.rejects)


def delete_stored(spark: SparkSession, root: str, match_ids: DataFrame) -> Snapshot:
    """I12 (ON DELETE CASCADE) on the stored star: drop the given matches and their odds.

    Only the files that hold one of them are written anew; all others keep their folders.
    """
    base, commit = _current(spark, root), new_commit()
    ids = match_ids.select("match_id").distinct().checkpoint(eager=True)
    match = read_matches(spark, root, base)
    hit = match.join(ids, "match_id", "left_semi").select("commit", "file_id").distinct().checkpoint(eager=True)
    dead = [tuple(r) for r in hit.collect()]     # the files that change
    if not dead:
        return base
    left = match.join(hit, ["commit", "file_id"], "left_semi").join(ids, "match_id", "left_anti").drop("commit")
    write_table(left, root, "match", commit, PARTS)
    moved = hit.select("file_id", F.col("commit").alias("facts"), F.lit(commit).alias("_now"))
    ledger = read_ledger(spark, root, base).join(moved, ["file_id", "facts"], "left").withColumn("facts", F.coalesce("_now", "facts"))
    return publish_star(spark, root, base, commit, None, ledger.select(*[c.name for c in _ledger_fields()]), buried({**base.facts, commit: []}, dead), base.rejects)


def _current(spark: SparkSession, root: str) -> Snapshot:
    found = current(spark, root)
    if found is None:
        raise FileNotFoundError(f"no star at {root}")
    return found


def write_star_bucketed(star: Star, root: str, buckets: int, table_prefix: str = "pitchside_",
                        mode: str = "overwrite") -> None:
    """Like :func:`write_star`, with ``match`` / ``match_odds`` bucketed by ``match_id`` as tables.

    When both facts are projections of one input (``odds_aligned``), that
    input is persisted for the two writes so it is derived once; lost blocks
    are recomputed from lineage.
    """
    shared = star.odds_aligned
    if shared is not None:
        from dataclasses import replace
        from pyspark import StorageLevel
        shared = shared.persist(StorageLevel.MEMORY_AND_DISK)
        star = replace(star, odds_aligned=shared, match=shared.select(*star.match.columns),
                       match_odds=shared.select(*star.match_odds.columns))
    try:
        _write_tables_bucketed(star, root, buckets, table_prefix, mode)
    finally:
        if shared is not None:
            shared.unpersist()


def _write_tables_bucketed(star: Star, root: str, buckets: int, table_prefix: str, mode: str) -> None:
    for name in STAR_TABLES:
        df = getattr(star, name)
        path = os.path.join(root, name)
        if name in ("match", "match_odds"):
            w = df.repartition(buckets, "match_id").write.mode(mode)
            if name == "match":
                w = w.partitionBy("season_id")
            (w.bucketBy(buckets, "match_id").sortBy("match_id").option("path", path)
             .saveAsTable(table_prefix + name))
        else:
            df.write.mode(mode).parquet(path)


def read_star_bucketed(spark, root: str, table_prefix: str = "pitchside_") -> Star:
    """Open a star written by :func:`write_star_bucketed` (facts through the catalog, keeping their buckets)."""
    tables = {name: spark.read.parquet(os.path.join(root, name))
              for name in STAR_TABLES if name not in ("match", "match_odds")}
    tables["match"] = spark.table(table_prefix + "match")
    tables["match_odds"] = spark.table(table_prefix + "match_odds")
    return Star(**tables)
