"""Plan shape checks: single fact scan for the two-sided view, no nested-loop joins,
pushed-down filters and pruned columns, bounded windows only."""

import json
import re

from pitchside.plans.questions import QUESTIONS, q1_consistency, q7a_aggression
from pitchside.plans.sinks import json_rows, write_json
from pitchside.plans.transforms import t1_team_view


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_q1_has_no_nested_loop_join(star001):
    p = plan(q1_consistency(star001))
    assert "BroadcastNestedLoopJoin" not in p
    assert "CartesianProduct" not in p


def test_team_view_scans_lineitem_once(star001):
    p = plan(t1_team_view(star001))
    assert p.count("Generate") == 1
    assert p.count("lineitem.parquet") == 1


def test_filters_pushed_and_columns_pruned(star001):
    p = plan(q7a_aggression(star001))
    assert "PushedFilters: [IsNotNull(o_orderdate)" in p
    # lineitem read schema has only the key columns and quantity
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double>" in p


def test_windows_only_above_aggregates_of_a_dimension(star001):
    """What feeds a window is an aggregate by season or by referee: one row for each, however many matches there are."""
    narrow = ("Sort", "Exchange", "Project", "Filter", "BroadcastHashJoin", "Window ")
    windows = 0
    for name, job in QUESTIONS.items():
        lines = plan(job(star001)).splitlines()
        for at, line in enumerate(lines):
            if re.search(r"- Window \[", line):
                nodes = (re.sub(r"^[\s:+-]*", "", below) for below in lines[at + 1:])
                feeding = next(node for node in nodes if not node.startswith(narrow))
                assert re.match(r"HashAggregate\(keys=\[(season|referee)_id#\d+L?\],", feeding), (name, feeding)
                windows += 1
    assert windows


def test_odds_join_on_a_loaded_star_moves_no_fact(spark, tmp_path):
    """After two loads into one star neither Q2 nor Q6 exchanges a fact: only partial aggregates and dimensions move."""
    from pitchside.plans.ingest import load_seasons
    from pitchside.plans.questions import q2_expected_points, q6_bookmaker
    from pitchside.sources.star import read_star
    from pitchside.streaming.season_stream import ingest_stream
    from tests.test_ingest import line, write
    src, out = str(tmp_path / "in"), str(tmp_path / "star")
    write(src, "season_2020_2021.csv", [line("12/09/2020", "Man City", "Arsenal", 2, 1, "H", 1, 0, "H", "M Dean")])
    load_seasons(spark, src, out)
    for y in (2021, 2022):
        write(src, f"season_{y}_{y + 1}.csv", [line(f"12/09/{y}", "Arsenal", "Man City", 2, 1, "H", 1, 0, "H", "M Dean")])
        ingest_stream(spark, src, out).awaitTermination()
    star = read_star(spark, out)
    for job in (q2_expected_points, q6_bookmaker):
        p = plan(job(star))
        assert "SortMergeJoin" not in p and "match_id" not in "".join(re.findall(r"Exchange hashpartitioning\([^)]*\)", p))
        lines = p.splitlines()
        for at, text in enumerate(lines):
            if "Exchange hashpartitioning" in text:
                assert "HashAggregate" in lines[at + 1] and "partial_" in lines[at + 1], text
    scans = [text for text in plan(q6_bookmaker(star)).splitlines() if "odds" in text and "FileScan" in text]
    # entries are pruned too: Q6 reads no column of a match that it does not use
    assert scans and all("home_shots" not in s for s in scans)
    assert [r.matches for r in star.match_odds.groupBy().agg({"match_id": "count"}).toDF("matches").collect()] == [3]


def test_json_sink(spark, star001, tmp_path):
    from pitchside.plans.questions import q5_scoring
    df = q5_scoring(star001)
    rows = [json.loads(r.json) for r in json_rows(df).collect()]
    assert {"season_name", "matches", "avg_total_goals"} <= set(rows[0])
    write_json(df, str(tmp_path / "q5"))
    assert spark.read.json(str(tmp_path / "q5")).count() == df.count()


def test_sql_over_star_views(spark, star001):
    from pitchside.plans.questions import q5_scoring
    from pitchside.sources.star import register_star_views
    register_star_views(star001, prefix="t_")
    sql = spark.sql("""
        SELECT s.name AS season_name, COUNT(*) AS matches,
               ROUND(STDDEV_POP(m.full_time_home_goals + m.full_time_away_goals), 2) AS goal_variability
        FROM t_match m JOIN t_season s ON s.season_id = m.season_id
        GROUP BY s.name ORDER BY s.name""").collect()
    df = q5_scoring(star001).select("season_name", "matches", "goal_variability").collect()
    assert [tuple(r) for r in sql] == [tuple(r) for r in df]


def test_projection_aggregates_on_the_order_key_partitioning(spark):
    from pitchside.sources.fixtures import match_source_rows
    from tests.conftest import SF001
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(match_source_rows(spark, SF001))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    line_exchanges = [l for l in p.split("\n") if "Exchange hashpartitioning(l_" in l]
    assert len(line_exchanges) == 2                          # by order key, then by supplier key
    assert any("hashpartitioning(l_orderkey#" in l and "l_linenumber" not in l for l in line_exchanges)


def test_projection_has_as_many_parts_as_its_lines_need(spark, monkeypatch):
    """A task of the join sorts and groups a bounded number of lines; parts are not merged by size."""
    from pitchside.sources import fixtures
    from tests.conftest import SF001
    monkeypatch.setattr(fixtures, "LINES_AT_ONCE", 200)
    lines = spark.read.parquet(f"{SF001}/lineitem.parquet")
    want = -(-lines.count() // 200)
    rows = fixtures.match_source_rows(spark, SF001)
    assert want > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.rdd.getNumPartitions() == want


def test_projection_keeps_every_order_year(spark):
    from pitchside.sources.fixtures import fixture_star
    from tests.conftest import SF001
    years = {r[0] for r in spark.read.parquet(f"{SF001}/orders.parquet").selectExpr("cast(year(o_orderdate) as long)").distinct().collect()}
    star = fixture_star(spark, SF001)
    assert {r.season_id for r in star.season.collect()} == years
    assert {r.season_id for r in star.match.select("season_id").distinct().collect()} == years


def test_bucketed_star_joins_odds_without_exchange(spark, star001, tmp_path):
    from pitchside.plans.ingest_star import read_star_bucketed, write_star_bucketed
    from pitchside.plans.questions import q2_expected_points, q6_bookmaker
    write_star_bucketed(star001, str(tmp_path / "star"), buckets=4, table_prefix="t_bucketed_")
    star = read_star_bucketed(spark, str(tmp_path / "star"), table_prefix="t_bucketed_")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for job in (q2_expected_points, q6_bookmaker):
            p = plan(job(star))
            assert "SortMergeJoin" in p
            assert "hashpartitioning(match_id" not in p          # both facts already bucketed by match_id
            assert sorted(map(tuple, job(star).collect())) == sorted(map(tuple, job(star001).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_dim_hints_only_within_bound(spark):
    from pitchside.operators.broadcast import small_dim
    df = spark.range(0, 100)
    assert "broadcast" in small_dim(df, max_rows=1000)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in small_dim(df, max_rows=10)._jdf.queryExecution().analyzed().toString().lower()


def test_registered_queries_stay_in_the_jvm_without_cross_joins_and_prune_columns(spark):
    from pitchside.plans.registry import registry
    from tests.conftest import SF001
    banned = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
              "FlatMapGroupsInPandas", "MapInPandas",
              # columns of the driver's tables no job needs: their absence shows column pruning
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate", "o_totalprice",
              "o_orderpriority", "c_acctbal", "c_mktsegment", "s_acctbal", "n_regionkey")
    for name, query in registry().items():
        p = plan(query(spark, SF001))
        found = [b for b in banned if b in p]
        assert not found, (name, found)
