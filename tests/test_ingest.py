"""I1-I12 on hand-written season files (FIXTURES.md §1 cases) in fresh temp folders."""

import os
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchside.operators.audit import audit, delete_matches
from pitchside.operators.conform import upsert
from pitchside.plans import ingest
from pitchside.plans.ingest import load_seasons
from pitchside.sources.season_csv import RAW_COLUMNS, HeaderMismatch, read_raw
from pitchside.sources.star import read_star

HEADER = ",".join(RAW_COLUMNS)


def line(date, home, away, fthg, ftag, ftr, hthg, htag, htr, ref, odds=("1.50", "4.00", "6.00"), extra=()):
    stats = ["12", "9", "5", "3", "10", "12", "6", "4", "2", "1", "0", "0"]
    return ",".join(["E0", date, home, away, str(fthg), str(ftag), ftr, str(hthg), str(htag), htr, ref,
                     *stats, *odds, *extra])


def write(folder, name, lines, header=HEADER):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(header + "\n" + "\n".join(lines) + "\n")


@pytest.fixture
def season_dir(tmp_path):
    d = str(tmp_path / "in")
    write(d, "season_2020_2021.csv", [
        line("12/09/2020", "Man City", "Arsenal", 2, 1, "H", 1, 0, "H", "M Dean"),
        line("13/09/2020", "man city ", "Chelsea", 0, 0, " D ", 0, 0, "", ""),          # case variant, padded FTR, blank HTR/referee
        line("14/09/2020", '"Brighton, and Hove"', "Arsenal", 1, 3, "A", 1, 1, "X", "M Dean"),  # quoted comma, invalid HTR
        line("15/09/2020", "Chelsea", "Arsenal", 1, 1, "Z", 0, 0, "D", "A Taylor"),     # invalid FTR: rejected
        line("31/02/2021", "Arsenal", "Chelsea", 1, 0, "H", 0, 0, "D", "A Taylor"),     # impossible date: rejected
        line("16/09/2020", "Arsenal", "Man City", 0, 2, "A", 0, 1, "A", "A Taylor", odds=("", "", "")),  # empty odds
    ])
    write(d, "season_2021_2022.csv", [
        line("14/08/2021", "Chelsea", "Man City", 1, 1, "D", 1, 0, "H", "M Dean", extra=("x", "y")),  # extra columns
        line("15/08/2021", "Arsenal", "Chelsea", 3, 0, "H", 1, 0, "H", "M Dean", extra=("x", "y", "z")),  # one more: ignored
        "E0,16/08/2021,Arsenal,Chelsea,1,0,H",                                          # short line: no HT goals
    ], header=HEADER + ",Extra1,Extra2")
    return d


def test_load_semantics(spark, season_dir, tmp_path):
    out = str(tmp_path / "star")
    res = load_seasons(spark, season_dir, out)
    star = read_star(spark, out)

    teams = sorted(r.name for r in star.team.collect())
    assert teams == ["Arsenal", "Brighton, and Hove", "Chelsea", "Man City"]          # one Man City (N. collation)
    refs = sorted(r.name for r in star.referee.collect())
    assert refs == ["A Taylor", "M Dean"]
    assert sorted(r.name for r in star.season.collect()) == ["2020-2021", "2021-2022"]

    m = star.match
    assert m.count() == 6
    rejected = {r.reason: r.n for r in res.rejected.select(F.explode("reasons").alias("reason"))
                .groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rejected == {"invalid full_time_result": 1, "invalid date": 1, "missing HTHG": 1, "missing HTAG": 1}

    rows = {(r.match_date.isoformat(), r.full_time_result, r.half_time_result, r.referee_id is None)
            for r in m.collect()}
    assert ("2020-09-13", "D", None, True) in rows      # padded FTR trimmed, blank HTR -> NULL, blank referee -> none
    assert ("2020-09-14", "A", None, False) in rows     # invalid HTR -> NULL, row kept (N12)
    odds = star.match_odds.join(m.where(F.col("match_date") == "2020-09-16"), "match_id")
    assert odds.where(F.col("home_win_odds").isNull()).count() == 1   # empty odds -> NULL (N16)

    violations = {r.rule: r.violations for r in audit(star).collect()}
    assert all(v == 0 for v in violations.values()), violations


def test_reload_is_idempotent(spark, season_dir, tmp_path):
    out = str(tmp_path / "star")
    load_seasons(spark, season_dir, out)
    first = sorted(tuple(r) for r in read_star(spark, out).match.collect())
    load_seasons(spark, season_dir, out)
    again = sorted(tuple(r) for r in read_star(spark, out).match.collect())
    assert first == again


def test_shifted_file_is_refused(spark, tmp_path):
    d = str(tmp_path / "bad")
    cols = list(RAW_COLUMNS)
    cols.insert(2, "Time")
    write(d, "season_2022_2023.csv", ["E0,01/01/2023,15:00,A,B,1,0,H,0,0,D,R,1,1,1,1,1,1,1,1,1,1,0,0,2.0,3.0,4.0"],
          header=",".join(cols))
    with pytest.raises(HeaderMismatch):
        read_raw(spark, d)


def test_names_agree_as_the_database_compares_them(spark):
    from pitchside.operators.conform import name_key, sql_name_key
    import duckdb
    pairs = [("Beşiktaş", "besiktas"), ("Łódź", "LODZ"), ("Vålerenga", "Valerenga "), ("Ferencváros", "FERENCVAROS"), ("Hafnarfjörður", "hafnarfjorður"),
             ("Málaga", "Ma\u0301laga"), ("Strømsgodset", "stromsgodset"), ("Preußen", "PREUSSEN"), ("Næstved", "naestved"), ("Việt Nam", "viet nam"), ("Đặng", "dang")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r.x == r.y for r in df.select(name_key("a").alias("x"), name_key("b").alias("y")).collect())
    keys = [tuple(r) for r in df.select(name_key("a"), name_key("b")).collect()]
    con = duckdb.connect()
    assert [con.execute(f"SELECT {sql_name_key('a')}, {sql_name_key('b')} FROM (SELECT ? AS a, ? AS b)", p).fetchone() for p in pairs] == keys
    other = spark.createDataFrame([("Leeds", "Leeds United"), ("Brann", "Bran"), (" Ajax", "Ajax"), ("Ağrı", "Agri")], "a string, b string")
    assert not any(r.same for r in other.select((name_key("a") == name_key("b")).alias("same")).collect())


def test_values_beyond_their_columns_are_rejected(spark, tmp_path):
    d = str(tmp_path / "wide")
    good = line("12/09/2020", "Man City", "Arsenal", 2, 1, "H", 1, 0, "H", "M Dean")
    write(d, "season_2020_2021.csv", [good, good.replace("Arsenal,2,1", "Arsenal,128,1"), good.replace(",12,9,", ",32768,9,"), good.replace("Man City", "M" * 101), good.replace("E0,", "E0E0E0E0E0E,")])
    out = str(tmp_path / "star")
    res = load_seasons(spark, d, out)
    assert res.counts.matches == res.star.match.count() == 1 and res.counts.rejected == res.rejected.count() == 4
    assert res.counts.reasons == {"out of range FTHG": 1, "out of range HS": 1, "too long HomeTeam": 1, "too long Div": 1}
    assert all(r.violations == 0 for r in audit(res.star).collect())
    assert load_seasons(spark, d, out).counts.matches == 0      # known files are not loaded again


def test_a_hot_line_spreads_over_tasks(spark, monkeypatch):
    """Copies are numbered as a window over all rows would number them; a line's copies are written out in runs by several tasks."""
    from pyspark.sql import Window
    from pitchside.plans import ingest
    monkeypatch.setattr(ingest, "COPIES_AT_ONCE", 16)
    rows = spark.range(0, 1500).select((F.col("id") % 400).alias("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("v"), F.lit(None).cast("string").alias("w"))
    hot = rows.unionByName(spark.range(0, 700).select(F.lit(-1).cast("long").alias("k"), F.lit(5).alias("v"), F.lit("x").alias("w")))
    got = ingest.numbered_copies(hot, ["k"], ["v"], "n")
    want = hot.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "w")).cast("long"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    tasks = got.where("k = -1").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 2 and sum(r["count"] for r in tasks) == 700


def test_upsert_updates_and_inserts(spark):
    dim = spark.createDataFrame([(1, "E0", "Old name", "England"), (2, "E1", "Championship", "England"), (3, "N1", "Eredivisie", "Netherlands")],
                                "league_id long, code string, name string, country string")
    rows = spark.createDataFrame([("E0", "Premier League"), ("SP1", "La Liga"), ("SP1", "La Liga"), ("N1", None)], "code string, name string")
    got = sorted(tuple(r) for r in upsert(dim, rows, "code", "league_id", ["name"]).select("league_id", "code", "name", "country").collect())
    assert got == [(1, "E0", "Premier League", "England"), (2, "E1", "Championship", "England"), (3, "N1", None, "Netherlands"), (4, "SP1", "La Liga", None)]


def test_cascade_delete(spark, season_dir, tmp_path):
    out = str(tmp_path / "star")
    load_seasons(spark, season_dir, out)
    star = read_star(spark, out)
    ids = star.match.where(F.col("full_time_result") == "A").select("match_id")
    after = delete_matches(star, ids)
    assert after.match.count() == star.match.count() - ids.count()
    assert after.match_odds.join(ids, "match_id").count() == 0


def test_audit_finds_violations(spark, star001):
    from dataclasses import replace
    bad_match = star001.match.unionByName(star001.match.limit(3))              # duplicate ids
    bad_match = bad_match.withColumn("referee_id", F.when(F.col("referee_id") == 5, F.lit(999)).otherwise(F.col("referee_id")))
    v = {r.rule: r.violations for r in audit(replace(star001, match=bad_match, odds_aligned=None)).collect()}
    assert v["pk match.match_id"] == 3
    assert v["fk match.referee_id"] > 0
    assert v["fk match.home_team_id"] == 0
    nulls = star001.match.withColumn("home_team_id", F.lit(None).cast("long")).withColumn("home_shots", F.lit(40_000))
    twins = star001.team.unionByName(star001.team.limit(1).select(F.lit(999).cast("long").alias("team_id"), F.lower("name").alias("name"), F.lit("x" * 30).alias("short_name")))
    v = {r.rule: r.violations for r in audit(replace(star001, match=nulls, team=twins, odds_aligned=None)).collect()}
    n = nulls.count()
    assert v["not null match keys"] == n and v["range match statistics"] == n
    assert v["unique team.name"] == 1 and v["length team"] == 1 and v["pk team.team_id"] == 0


def test_reload_one_season(spark, star001, tmp_path):
    from dataclasses import replace
    from pitchside.plans.ingest_star import reload_season, write_star
    root = str(tmp_path / "star")
    write_star(star001, root)
    before = {r.season_id: r.n for r in read_star(spark, root).match.groupBy("season_id")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    # season 1997 arrives again with only its home wins: that partition alone is replaced
    changed = replace(star001, match=star001.match.where(F.col("full_time_result") == "H"))
    reload_season(spark, changed, root, 1997)
    after = {r.season_id: r.n for r in read_star(spark, root).match.groupBy("season_id")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    expected_1997 = star001.match.where((F.col("season_id") == 1997) & (F.col("full_time_result") == "H")).count()
    assert after[1997] == expected_1997 < before[1997]
    assert {k: v for k, v in after.items() if k != 1997} == {k: v for k, v in before.items() if k != 1997}
    # its odds came with it: every match has one odds row, and no odds row is left over
    star = read_star(spark, root)
    assert star.match.join(star.match_odds, "match_id").count() == star.match.count() == star.match_odds.count()


def test_another_league_and_kept_columns(spark, season_dir, tmp_path):
    from pitchside.plans.ingest import LoadSpec
    out = str(tmp_path / "star")
    first = load_seasons(spark, season_dir, out).star
    first.team = first.team.withColumn("short_name", F.upper(F.substring("name", 1, 3)))
    spec = LoadSpec("SP1", "La Liga", "Spain", "PIN", "Pinnacle")
    star = load_seasons(spark, season_dir, str(tmp_path / "again"), first, spec).star
    assert {(r.code, r.league_id) for r in star.league.collect()} == {("E0", 1), ("SP1", 2)}
    assert {r.league_id for r in star.match.select("league_id").distinct().collect()} == {2}
    assert {r.bookmaker_id for r in star.match_odds.select("bookmaker_id").distinct().collect()} == {2}
    assert {r.name: r.short_name for r in star.team.collect()}["Arsenal"] == "ARS"


def test_distributed_id_assignment_matches_window(spark):
    from pitchside.operators.conform import assign_ids
    names = spark.range(0, 5000).select(F.format_string("name_%05d", (F.col("id") * 7919) % 5000).alias("name"))
    existing = spark.createDataFrame([(41, "old")], "team_id long, name string")
    small = {r.name: r.team_id for r in assign_ids(names.repartition(7), existing, "team_id", ["name"]).collect()}
    big = {r.name: r.team_id for r in assign_ids(names.repartition(7), existing, "team_id", ["name"],
                                                 single_task_rows=10).collect()}
    assert small == big
    assert sorted(small.values()) == list(range(42, 5042))


def test_copies_of_a_line_are_separate_matches(spark, tmp_path):
    d = str(tmp_path / "copies")
    same = line("12/09/2020", "Man City", "Arsenal", 2, 1, "H", 1, 0, "H", "M Dean")
    write(d, "season_2020_2021.csv", [same] * 5 + [line("13/09/2020", "Chelsea", "Arsenal", 0, 0, "D", 0, 0, "D", "M Dean")])
    star = load_seasons(spark, d).star
    assert star.match.select("match_id").distinct().count() == 6
    assert star.match.join(star.match_odds, "match_id").count() == 6     # one odds row each, no pairs of copies
    v = {r.rule: r.violations for r in audit(star).collect()}
    assert v["pk match.match_id"] == 0 and v["duplicate match content"] == 4


def test_one_pass_dimension_names_match_per_set_names(spark, season_dir):
    from pitchside.operators.conform import distinct_names
    from pitchside.plans.ingest import clean, dimension_names, tag_season
    from pitchside.sources.season_csv import SOURCE_COL
    cleaned = clean(tag_season(read_raw(spark, season_dir)))
    names = dimension_names(cleaned)
    for kind, cols in (("team", ["home_name", "away_name"]), ("referee", ["referee_name"])):
        one = sorted(tuple(r) for r in names.where(F.col("kind") == kind).select("name_key", "name").collect())
        per = sorted(tuple(r) for r in distinct_names(cleaned, cols, SOURCE_COL).select("name_key", "name").collect())
        assert one == per
    assert sorted(r.name for r in names.where(F.col("kind") == "season").collect()) == ["2020-2021", "2021-2022"]


def test_rows_whose_key_stands_alone_are_not_shuffled(spark):
    """A key's hashes are shuffled, and the copies; the other rows meet the few repeated keys by broadcast."""
    rows = spark.range(2000).select((F.col("id") % 1990).cast("string").alias("k"), (F.col("id") % 7).alias("v"), F.lit("a file").alias("f"))
    got = ingest.numbered_copies(rows, ["k"], ["v"], "n", together=["f"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "LeftAnti, BuildRight" in plan
    assert got.groupBy("k").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("c")).where("n <> c or c > 2").isEmpty()
    assert got.count() == 2000


def test_copies_of_a_line_are_shuffled_once(spark):
    """Rows of a repeated key meet by one exchange of whole rows, however many there are; the crowded keys' way is not taken."""
    rows = spark.range(4000).select((F.col("id") % 500).cast("string").alias("k"), (F.col("id") % 7).alias("v"), F.lit("a file").alias("f"))
    got = ingest.numbered_copies(rows, ["k"], ["v"], "n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?:hash|range|round)\w*partitioning", plan, re.I)) == 1
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "f")).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_facts_are_derived_once_for_several_readers(spark, season_dir):
    """Match and odds are views of one written table; nothing of the numbering is left in their plans."""
    result = ingest.load_frames(read_raw(spark, season_dir))
    held = ingest.with_written_facts(result).star
    for name in ("match", "match_odds"):
        plan = getattr(held, name)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "loaded-facts" in plan
        assert sorted(map(str, getattr(held, name).collect())) == sorted(map(str, getattr(result.star, name).collect()))


def test_season_files_are_kept_as_a_table(spark):
    """A checkpoint of the rows took ten times the space."""
    from pitchside.plans.ingest_outputs import season_files
    from tests.conftest import SF001
    rows = season_files(spark, SF001)
    assert "FileScan parquet" in rows._jdf.queryExecution().executedPlan().toString()


def test_audit_tells_nulls_apart(spark, star001):
    """Rows with NULL in different columns are different content, and equal rows are not."""
    from dataclasses import replace
    one = star001.match.limit(1)
    other = [c for c in one.columns if c != "match_id"]
    put = lambda n, **null: one.select(F.lit(n).alias("match_id"), *[F.lit(None if c in null or c == "match_date" else 1).cast(one.schema[c].dataType).alias(c) for c in other])
    match = put("a", home_shots=1).unionByName(put("b", away_shots=1)).unionByName(put("c", away_shots=1)).unionByName(put("d", home_shots=1, away_shots=1))
    found = {r.rule: r.violations for r in audit(replace(star001, match=match)).collect()}
    assert found["duplicate match content"] == 1


def test_spellings_are_folded_once_and_resolve_to_one_team(spark):
    """Every spelling of a name finds the same team, and the spelling seen first is kept."""
    columns = ["home_name", "away_name", "referee_name", "season_name", ingest.SOURCE_COL]
    rows = spark.createDataFrame([("Beşiktaş", "Łódź", None, "2019-2020", "b"), ("besiktas ", "LODZ", " ", "2019-2020", "a"),
                                  ("Beşiktaş", None, "M Dean", None, "a")], ", ".join(f"{c} string" for c in columns))
    spelled = ingest.spelled_names(rows)
    keys = {(r["kind"], r["name"]): (r["name_key"], r["first_file"]) for r in spelled.collect()}
    assert keys == {("team", "Beşiktaş"): ("besiktas", "a"), ("team", "besiktas "): ("besiktas", "a"), ("team", "Łódź"): ("lodz", "b"),
                    ("team", "LODZ"): ("lodz", "a"), ("referee", "M Dean"): ("m dean", "a"), ("season", "2019-2020"): ("2019-2020", "a")}
    first = {(r["kind"], r["name_key"]): r["name"] for r in ingest.first_spellings(spelled).collect()}
    assert first[("team", "lodz")] == "LODZ" and first[("team", "besiktas")] == min("Beşiktaş", "besiktas ", key=str.encode)


def steps_before_rows_move(df):
    """For every scan of ``spark.range`` in the plan, its steps up to the first exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [plan[:at.start()].rsplit("Exchange", 1)[1] for at in re.finditer(r"Range \(", plan)]


def match_rows(spark, n=600):
    pick = lambda values: F.array(*map(F.lit, values))[(F.col("id") % len(values)).cast("int")]
    return spark.range(n).select(pick(["Arsenal", "arsenal ", " ", None, "Łódź"]).alias("home_name"), pick(["LODZ", "Chelsea", None]).alias("away_name"),
                                 pick(["M Dean", "m dean"]).alias("referee_name"), pick(["2020-2021", None, "2019-2020"]).alias("season_name"),
                                 pick(["b", "a", None, "c"]).alias(ingest.SOURCE_COL))


def test_names_are_made_distinct_without_sorting_the_rows(spark):
    """The smallest file of a name is sought among distinct names, not by sorting every row of a task."""
    from pitchside.operators.conform import distinct_names
    rows = match_rows(spark)
    per_set = distinct_names(rows, ["home_name", "away_name"], ingest.SOURCE_COL)
    for names in (ingest.dimension_names(rows), ingest.spelled_names(rows), per_set):
        steps = steps_before_rows_move(names)
        assert steps and all("HashAggregate" in s and "Sort" not in s for s in steps)
    first = {}
    for r in rows.collect():
        for name in (r.home_name, r.away_name):
            if name and name.strip():
                seen = (r[ingest.SOURCE_COL] or "", name.encode())
                key = name.rstrip().lower().replace("ł", "l").replace("ó", "o").replace("ź", "z")
                first[key] = min(first.get(key, seen), seen)
    want = sorted((k, name.decode()) for k, (_, name) in first.items())
    assert sorted(map(tuple, per_set.collect())) == want


def test_seasons_are_made_distinct_without_sorting_the_rows(spark):
    """The upsert takes the largest of a season's rows; before it there is one row per label, not every row of a task."""
    existing = spark.createDataFrame([(1, "2019-2020", 1, 1), (2, "2018-2019", 2018, 2019)], "season_id long, name string, start_year short, end_year short")
    got = upsert(existing, ingest.season_rows(match_rows(spark)), "name", "season_id", ["start_year", "end_year"])
    steps = steps_before_rows_move(got)
    assert steps and all("HashAggregate" in s and "Sort" not in s for s in steps)
    assert sorted(map(tuple, got.collect())) == [(1, "2019-2020", 2019, 2020), (2, "2018-2019", 2018, 2019), (3, "2020-2021", 2020, 2021)]


def test_many_repeated_keys_are_numbered_with_one_exchange(spark, monkeypatch):
    """Keys too many to be broadcast are not joined to the rows, which would shuffle them before the window does; crowds go their own way."""
    monkeypatch.setattr(ingest, "FEW_KEYS", 10)
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, F.col("id") % 500).otherwise(F.col("id")).cast("string").alias("k"), (F.col("id") % 7).alias("v"), F.lit("a file").alias("f"))
    want = sorted(map(tuple, rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "f")).cast("long")).collect()))
    got = ingest.numbered_copies(rows, ["k"], ["v"], "n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange (?:hash|range|round)\w*partitioning", plan, re.I)) == 1 and "Join" not in plan
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(ingest, "COPIES_AT_ONCE", 4)
    assert sorted(map(tuple, ingest.numbered_copies(rows, ["k"], ["v"], "n").collect())) == want


@pytest.mark.parametrize("few", [10, 10_000])
def test_turns_hold_every_row_once_and_all_copies_of_a_key(spark, monkeypatch, few):
    monkeypatch.setattr(ingest, "FEW_KEYS", few)
    rows = spark.range(2000).select((F.col("id") % 1300).cast("string").alias("k"), (F.col("id") % 7).alias("v"), F.lit("a file").alias("f"))
    parts = [list(map(tuple, p.collect())) for p in ingest.numbered_in_turns(rows, ["k"], ["v"], "n", ["f"], 3)]
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "f")).cast("long"))
    assert sorted(r for p in parts for r in p) == sorted(map(tuple, want.collect()))
    keys = [{r[0] for r in p} for p in parts]
    assert all(keys) and sum(map(len, keys)) == 1300


def test_what_the_facts_came_from_goes_and_odds_join_moves_no_fact(spark, monkeypatch):
    """Of a star with written facts only these stay in the shared folder, and match and odds come together without an exchange."""
    from urllib.parse import urlparse
    from pitchside.plans import ingest_outputs
    from pitchside.session import checkpoint_root
    from tests.conftest import SF001
    names = lambda: {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before}
    root = urlparse(checkpoint_root(spark)).path
    before = set(os.listdir(root))
    star = ingest_outputs._star_with_facts(spark, SF001)
    assert "loaded-facts" in names() and not {"season-files", "cleaned-rows"} & names()
    joined = star.matches_with_odds()
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, joined.select("match_id", "season_id", "home_win_odds").collect())) == sorted(map(str, star.match.join(star.match_odds, "match_id").select("match_id", "season_id", "home_win_odds").collect()))


def test_a_load_in_turns_is_the_same_load(spark, season_dir, tmp_path, monkeypatch):
    """Facts that are written turn by turn are those that are written at once, in memory and in the stored star."""
    plain = lambda star: sorted(map(str, star.matches_with_odds().collect()))
    once = load_seasons(spark, season_dir, str(tmp_path / "once"))
    monkeypatch.setattr(ingest, "LINES_A_TURN", 3)
    turns = load_seasons(spark, season_dir, str(tmp_path / "turns"))
    assert turns.counts == once.counts and turns.counts.matches == 6
    assert plain(turns.star) == plain(once.star)
    result = ingest.load_frames(read_raw(spark, season_dir), in_turns=True)
    assert len(result.turns) > 1
    assert sorted(map(str, ingest.with_written_facts(result).star.match.collect())) == sorted(map(str, ingest.load_frames(read_raw(spark, season_dir)).star.match.collect()))


def test_audit_moves_digests_one_kind_of_key_at_a_time(spark, star001, monkeypatch):
    """What is shuffled is numbers only, and the keys that every match has of its own do not lie on disk together."""
    from pitchside.operators import audit as module
    moved, real = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: moved.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    assert {r.violations for r in audit(star001).collect()} == {0}
    assert len(moved) == 3
    for plan in moved:
        assert re.search(r"hashpartitioning\(kind#\d+, high#\d+L?, low#\d+L?, \d+\)", plan)
