"""Operators on small inputs with known results."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navgraph.functions import costs
from navgraph.functions.titles import fold, readable, sanitize
from navgraph.operators import games, links, paths, race, ratings, tasks
from navgraph.plans import live
from navgraph.sources import dumps
from navgraph.streaming import events

GAMES = [
    ("g1", "Apple", "Banana", "alpha", 5), ("g2", "Apple", "Banana", "beta", 10), ("g3", "Apple", "Banana", "gamma", 30), ("g4", "Cat", "Dog", "alpha", 3),
    ("g5", "Cat", "Dog", "beta", 3), ("g6", "Cat", "Dog", "gamma", 8), ("g7", "Xylophone", "Zebra", "alpha", 2),
]


def test_ratings(spark):
    df = spark.createDataFrame(GAMES, "game_id string, start_page_title string, target_page_title string, model_id string, steps int")
    matrix = ratings.win_matrix(ratings.comparisons(ratings.per_task(df)))
    assert {(r.model, r.opponent): r.wins for r in matrix.collect()} == {
        ("alpha", "beta"): 1.5, ("beta", "alpha"): 0.5, ("alpha", "gamma"): 2, ("gamma", "alpha"): 0, ("beta", "gamma"): 2, ("gamma", "beta"): 0,
    }
    strength = {r.model: round(r.strength, 6) for r in ratings.strengths(matrix).collect()}
    assert strength == {"alpha": 2.248764, "beta": 0.751236, "gamma": 0.0}
    assert [(r.model, r.rating) for r in ratings.leaderboard(df).collect()] == [("alpha", 1341), ("beta", 1150), ("gamma", -2400)]


def test_titles(spark):
    odd = ["Farmers' market", 'a "b"', "Complex/Title\\With|Special*Characters", "  x  y ", "ÉCOLE"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", sanitize(F.col("t")).alias("s"), readable(sanitize(F.col("t"))).alias("r"), fold(F.col("t")).alias("f")).collect()
    assert [r.s for r in rows] == ["Farmers\\'_market", 'a_\\"b\\"', "Complex/Title\\\\With|Special*Characters", "x__y", "ÉCOLE"]
    assert [r.r for r in rows[:3]] == odd[:3] and rows[4].f == "École"


@pytest.mark.parametrize(("i", "o", "p", "c", "want"), [(150, 75, 0.25, 1.25, 0.00013125), (500, 200, 3.0, 15.0, 0.0045), (300, 100, 0.15, 0.60, 0.000105)])
def test_costs(spark, i, o, p, c, want):
    got = spark.range(1).select(costs.plain(F.lit(i), F.lit(o), F.lit(p), F.lit(c)).alias("a"), costs.plain(F.lit(i), F.lit(o), F.lit(0.0), F.lit(c)).alias("b")).first()
    assert abs(got.a - want) < 1e-12 and got.b == 0


def test_redirect_chains(spark):
    chain = [(k, k + 1) for k in range(1000, 1103)] + [(1, 2), (2, 3), (3, 1), (4, 2), (5, 6)]
    found = {r.source_id: r.target_id for r in links.resolve_redirects(spark.createDataFrame(chain, "source_id long, target_id long")).collect()}
    want = {}
    direct = dict(chain)
    for source, first in chain:
        cur, hops = first, 0
        while cur in direct and cur is not None:
            cur, hops = direct[cur], hops + 1
            if cur == first or hops > 100:
                cur = None
        if cur is not None:
            want[source] = cur
    assert found == want


def test_paths_have_one_length(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (2, 4), (3, 4), (4, 5), (6, 1)], "src_id long, dst_id long")
    pairs = spark.createDataFrame([(1, 1, 5), (2, 1, 1), (3, 5, 1), (4, 6, 2), (5, 1, 99)], "query_id long, src_id long, dst_id long")
    got: dict = {}
    for r in paths.shortest_paths(edges, pairs).collect():
        got.setdefault(r.query_id, set()).add(tuple(r.path))
    assert got == {1: {(1, 2, 4, 5), (1, 3, 4, 5)}, 2: {(1,)}, 4: {(6, 1, 2)}}
    assert paths.shortest_paths(edges, pairs, max_paths=1).filter("query_id = 1").count() == 1
    many = paths.shortest_paths(edges, pairs, max_paths=1).collect()
    assert {(r.query_id, r.length, tuple(r.path) in got[r.query_id]) for r in many} == {(1, 3, True), (2, 0, True), (4, 2, True)} and len(many) == 3
    assert paths.levels(edges, spark.createDataFrame([(1, 1)], "query_id long, node long"), max_levels=1).count() == 3


def test_dump_lines(spark):
    line = r"INSERT INTO `page` VALUES (1,0,'A),(B',0,0.1),(2,14,'It\'s (here)',1,0.2),(3,0,NULL,0,0.3);"
    text = spark.createDataFrame([(line,), ("-- comment",), ("INSERT INTO `other` VALUES (9,0,'x',0,1);",)], "value string")
    assert [(r.page_id, r.title) for r in dumps.parse_inserts(text, dumps.PAGE).collect()] == [(1, "A),(B"), (2, r"It\'s (here)")]
    assert [r.page_id for r in dumps.parse_inserts(text, dumps.PAGE, compat=True).collect()] == [2]
    pl = spark.createDataFrame([("INSERT INTO `pagelinks` VALUES (1,0,7),(2,0,8);",)], "value string")
    assert [tuple(r) for r in dumps.parse_inserts(pl, dumps.PAGELINKS).collect()] == [(1, 0, 7), (2, 0, 8)]


def test_tsv_and_json(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('1\t0\tA "b"\n2\t0\nx\t0\tC\n4\t0\tD\tmore\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ns", T.IntegerType()), T.StructField("title", T.StringType())])
    good, bad = dumps.read_tsv(spark, str(tmp_path / "t.tsv"), schema)
    assert [tuple(r) for r in good.collect()] == [(1, 0, 'A "b"'), (4, 0, "D")] and bad.count() == 2
    game = {"game_id": "g", "model_id": "m", "config": {"start_page_title": "A", "target_page_title": "B", "max_steps": 3}, "status": "won", "steps": 2}
    (tmp_path / "g.jsonl").write_text("\n".join([json.dumps(game), "{broken", json.dumps({"game_id": "x"}), ""]))
    good, bad = dumps.read_games(spark, str(tmp_path / "g.jsonl"))
    assert [r.game_id for r in good.collect()] == ["g"] and bad.count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"id": "p/a", "name": "old", "created": 1, "pricing": {"prompt": "0.000001"}}, {"id": "p/a", "name": "new", "created": 2, "pricing": {"prompt": "0.000002", "completion": "x"}}]}))
    (model,) = tasks.model_info(dumps.read_catalogue(spark, str(tmp_path / "c.json"))).collect()
    assert (model["name"], model.provider, round(model.input_price, 6), model.output_price) == ("new", "p", 2.0, 0.0)


def test_outcomes(spark):
    attempts = [("won", 1, 1, "B", None), ("lost", 1, 1, "C", None), ("lost", 2, 1, "D", None), ("bad", 1, 1, None, "model_invalid_link"), ("bad", 1, 2, None, "model_invalid_link"), ("again", 1, 1, None, "model_invalid_link"), ("again", 1, 2, "C", None), ("err", 1, 1, None, "provider_timeout"), ("edge", 1, 1, "C", None), ("edge", 2, 1, "B", None)]
    a = spark.createDataFrame(attempts, "game_id string, turn int, attempt int, to_page_title string, error string")
    c = spark.createDataFrame([(g, "B", 2) for g in ("won", "lost", "bad", "again", "err", "edge", "none")], "game_id string, target_page_title string, max_steps int")
    assert {r.game_id: (r.steps, r.status) for r in games.outcomes(a, c).collect()} == {
        "won": (1, "won"), "lost": (2, "lost_max_steps"), "bad": (0, "lost_invalid_move"), "again": (1, "in_progress"), "err": (0, "error"), "edge": (2, "won"), "none": (0, "not_started"),
    }


def test_progress(spark):
    rows = [("g", 0, 4), ("g", 1, 3), ("g", 2, None), ("g", 3, 6), ("g", 4, 0)]
    s = spark.createDataFrame(rows, "game_id string, move_index long, distance long")
    assert [round(r.progress, 4) for r in race.progress(s).orderBy("move_index").collect()] == [1.0, 25.75, 25.75, -48.5, 100.0]
    assert [r.change for r in race.distance_change(s).orderBy("move_index").collect()] == [None, 1, None, None, 6]


def test_repeated_events_count_once(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts, id % 3 AS user_id, 'click' AS event_type, 1.0D AS value, '{}' AS props FROM range(30)")
    rows.write.parquet(str(tmp_path / "in"))
    rows.limit(10).write.mode("append").parquet(str(tmp_path / "in"))
    out = events.drain(events.count_by_type(events.once(events.event_stream(spark, str(tmp_path / "in")))), "complete", ["type"])
    assert [(r.type, r.n) for r in out.collect()] == [("move_completed", 30)]


def out_of_order(spark, folder, files):
    """Files of two events each, the latest times first; one event is repeated a day later, two have no id."""
    for i in range(files):
        late = files - i
        rows = [(2 * i, late), (2 * i + 1, late)] if i else [(0, late), (None, late), (None, late), (2, late + 24)]
        made = spark.createDataFrame(rows, "event_id long, h int").selectExpr("event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,h) AS ts", "1L AS user_id", "'click' AS event_type", "1.0D AS value", "'{}' AS props").toPandas()
        made["event_id"] = made["event_id"].astype("Int64")
        made["ts"] = made["ts"].astype("datetime64[us]")
        path = folder / f"part-{i:03d}.parquet"
        made.to_parquet(path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def test_whole_table_counts_do_not_depend_on_files(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    out_of_order(spark, tmp_path / "events.parquet", 70)
    assert [(r.type, r.n) for r in live.event_counts(spark, str(tmp_path)).collect()] == [("move_completed", 141)]


def test_live_counts_lose_only_what_is_later_than_the_lateness(spark, tmp_path):
    for i, hours in enumerate([[10, 10], [9.5, 10], [3, 10.25]]):
        rows = [(10 * i + k, float(h)) for k, h in enumerate(hours)] + ([(0, 10.0)] if i else [])
        made = spark.createDataFrame(rows, "event_id long, h double").selectExpr("event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,CAST(60 * h AS int)) AS ts", "1L AS user_id", "'click' AS event_type", "1.0D AS value", "'{}' AS props").toPandas()
        made["ts"] = made["ts"].astype("datetime64[us]")
        made.to_parquet(tmp_path / f"part-{i}.parquet")
        os.utime(tmp_path / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    out = events.drain(events.count_by_type(events.once(events.event_stream(spark, str(tmp_path), files_per_trigger=1))), "complete", ["type"])
    assert [(r.type, r.n) for r in out.collect()] == [("move_completed", 5)]


def test_strategies_and_prompts(spark):
    from navgraph.operators import sessions as S

    assert S.strategy_info("themed") is None and S.strategy_info("custom", target="B") | {"description": ""} == {"strategy": "custom", "language": "en", "description": "", "start_page": "random", "target_page": "B"}
    row = spark.sql("SELECT array('A', 'B') AS links, CAST(NULL AS array<string>) AS no, map('x', 'y') AS given").select(
        S.turn_prompt(F.lit("T"), F.col("links"), first=True).alias("p"), S.is_link(F.col("no"), F.lit("A")).alias("l"), S.missing_arguments(["x", "z"], F.col("given")).alias("m"), S.link_page(F.lit("T"), F.array().cast("array<string>")).alias("e")
    ).first()
    assert row.p == "You are currently on the page 'T'.\nHere are the available links:\n['A', 'B']"
    assert row.l is False and row.m == ["z"] and row.e == "Current Page: T\nNo links found on this page."
