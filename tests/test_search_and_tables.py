"""Searches whose frontier is bits, and tables that are seen whole or not at all."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from navgraph.operators import paths, race, sessions
from navgraph.operators.store import GraphStore
from navgraph.plans import play, tasks
from navgraph.session import shared_dir
from navgraph.sources import tables, views


def bfs(edges, start):
    seen, front, level = {start: 0}, [start], 0
    while front:
        level += 1
        front = sorted({b for a in front for b in edges[a] if b not in seen})
        seen |= {b: level for b in front}
    return seen


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(3)
    pairs = {(rng.randrange(300), rng.randrange(300)) for _ in range(700)} | {(k, k + 1) for k in range(400, 420)}
    back = defaultdict(list)
    for a, b in pairs:
        back[b].append(a)
    return spark.createDataFrame(sorted(pairs), "src_id long, dst_id long").cache(), back


def test_bits_find_what_rows_find(spark, net):
    edges, back = net
    starts = [(q, q % 290) for q in range(150)] + [(150, 420), (151, 999), (7, 9)]  # three words of queries; one of two nodes, one of none
    df = spark.createDataFrame(starts, "query_id long, node long")
    got = {(r.query_id, r.node): r.level for r in paths.bit_levels(edges, df, backward=True).collect()}
    want: dict = {}
    for q, s in starts:
        for node, level in bfs(back, s).items():
            want[q, node] = min(level, want.get((q, node), 999))
    assert got == want
    assert got == {(r.query_id, r.node): r.level for r in paths.levels(edges, df, backward=True).groupBy("query_id", "node").agg(F.min("level").alias("level")).collect()}
    wanted = [(q, (q * 37) % 300) for q in range(152)] + [(q, q % 290) for q in range(0, 150, 5)] + [(150, 400), (150, 100), (3, 3000)]
    asked = spark.createDataFrame(wanted + wanted[:20], "query_id long, node long")
    found = {(r.query_id, r.node): r.level for r in paths.bit_levels(edges, df, asked, backward=True).collect()}
    assert found == {k: want[k] for k in set(wanted) if k in want} and found[150, 400] == 20
    assert paths.bit_levels(edges, df.limit(0), backward=True).count() == 0 and paths.bit_levels(edges, df, asked.limit(0), backward=True).count() == 0


def test_queries_leave_the_search_when_their_nodes_are_reached(spark, monkeypatch):
    """A chain of 60 nodes, asked for two that are near: the search ends after two levels."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "src_id long, dst_id long")
    made, keep = [], paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda df, label: made.append(label) or keep(df, label))
    starts = spark.createDataFrame([(1, 60), (2, 30)], "query_id long, node long")
    asked = spark.createDataFrame([(1, 58), (2, 29), (2, 77)], "query_id long, node long")
    got = {(r.query_id, r.node): r.level for r in paths.bit_levels(edges, starts, asked, backward=True).collect()}
    assert got == {(1, 58): 2, (2, 29): 1} and made.count("search") == 3


def test_distances_of_pairs_in_use(spark, net):
    edges, back = net
    pages = spark.createDataFrame([(k, f"P{k}") for k in range(300)], "page_id long, title string")
    pairs = spark.createDataFrame([("P5", f"P{k}") for k in range(0, 300, 7)] + [("P5", "P5"), ("P5", "Nowhere"), ("Nowhere", "P5")], "target_page_title string, page_title string")
    got = {r.page_title: r.distance for r in race.distances_in_use(edges, pages, pairs).collect()}
    near = bfs(back, 5)
    assert got == {f"P{k}": near[k] for k in [*range(0, 300, 7), 5] if k in near}


def test_tables_are_built_once_until_their_source_changes(spark, tmp_path):
    source, made = str(tmp_path / "source"), []

    def build():
        made.append(1)
        return spark.read.parquet(source)

    spark.range(5).write.parquet(source)
    name, of = f"test-{tmp_path.name}-{tmp_path.stat().st_ino}", f"ids of {source}"
    first = tables.fingerprint(spark, [source])
    assert all(tables.kept(spark, f"{name}-{first}", build, of=of).df.count() == 5 for _ in range(2)) and len(made) == 1
    old = tables.kept(spark, f"{name}-{first}", build).folder
    spark.range(3).write.mode("append").parquet(source)
    second = tables.fingerprint(spark, [source])
    assert second != first and tables.fingerprint(spark, [source]) == second
    new = tables.kept(spark, f"{name}-{second}", build, of=of)
    assert new.df.count() == 8 and len(made) == 2
    # The older table is out of sight at once; its folder goes when nobody can be reading it any more.
    base = f"{shared_dir(spark)}/navgraph/kept"
    assert tables.read_text(spark, f"{base}/{name}-{first}.json") is None and spark.read.parquet(old).count() == 5
    assert tables.retire(spark, of, keep=f"{name}-{second}.json", grace_s=-1) == [old] and not tables.list_files(spark, old)
    assert new.df.count() == 8


def test_half_written_tables_are_never_read(spark, tmp_path):
    name = f"half-{tmp_path.stat().st_ino}"

    def broken():
        return spark.range(100).repartition(4).select(F.when(F.col("id") == 50, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        tables.kept(spark, name, broken)
    assert tables.kept(spark, name, lambda: spark.range(7).toDF("id")).df.count() == 7


def test_of_two_builders_the_first_is_used(spark, tmp_path):
    name = f"race-{tmp_path.stat().st_ino}"

    def late():
        tables.kept(spark, name, lambda: spark.range(1).toDF("id"))  # another writer is done in the meantime
        return spark.range(2).toDF("id")

    assert tables.kept(spark, name, late).df.count() == 1
    folders = {f.rsplit("/", 2)[1] for f, _, _ in tables.list_files(spark, f"{shared_dir(spark)}/navgraph/kept") if f"/{name}-" in f}
    assert len(folders) == 1


def test_lookups_open_only_the_files_that_can_hold_their_keys(spark, tmp_path):
    pages = spark.range(1, 4001).select(F.col("id").alias("page_id"), F.lit(0).alias("namespace"), F.concat(F.lit("T"), "id").alias("title"), F.lit(False).alias("is_redirect"), F.concat(F.lit("t"), "id").alias("folded"))
    name = f"lookup-{tmp_path.stat().st_ino}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    by_id = tables.kept(spark, f"{name}-id", lambda: pages, "page_id", ["folded"])
    by_title = tables.kept(spark, f"{name}-title", lambda: pages, "folded", ["page_id"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(by_id.files) == len(by_title.files) == 4
    assert len(by_id.holding([17]).inputFiles()) == 1 and by_id.holding([17, None]).first().title == "T17" and by_id.holding([]).count() == by_id.holding([9999]).count() == 0
    none = spark.createDataFrame([], "source_id long, target_id long")
    store = GraphStore(pages, none, none, by_title=by_title, by_id=lambda: by_id)
    ids = spark.createDataFrame([(3,), (3,), (4000,), (5000,), (None,)], "page_id long")
    assert sorted((r.page_id or 0, r.title or "") for r in store.titles(ids).collect()) == [(0, ""), (3, "T3"), (3, "T3"), (4000, "T4000"), (5000, "")]
    assert len(store.pages_with(ids.limit(1)).inputFiles()) == 1 and store.by_title("t 8").count() == 0 and store.by_title(" T8 ").first().page_id == 8
    assert {r.title: r.page_id for r in store.resolve(spark.createDataFrame([("t9",), ("no",)], "title string")).collect()} == {"t9": 9, "no": None}
    assert store.titles(spark.range(1, 3000).toDF("page_id")).filter("title IS NULL").isEmpty()  # too many to choose files by


def test_commits_are_all_or_nothing(spark, tmp_path):
    commits = tables.Commits(spark, str(tmp_path / "c"))
    assert commits.version() == 0 and commits.read("a") is None
    assert commits.append(a=spark.range(3), b=spark.range(2)) == 1
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        commits.append(a=spark.range(10), b=broken)
    assert commits.version() == 1 and commits.read("a").count() == 3 and commits.read("b").count() == 2
    kept = {f.rsplit("/", 1)[0] for f, _, _ in tables.list_files(spark, str(tmp_path / "c")) if "/_commits/" not in f}
    assert len(kept) == 2  # nothing of the failed one is left
    with pytest.raises(ValueError, match="other columns"):
        commits.append(a=spark.range(1).toDF("other"))
    assert commits.append(a=spark.range(4)) == 2 and commits.read("a").count() == 7 and commits.read("a", 1).count() == 3 and commits.read("b").count() == 2


def test_commits_of_two_writers_both_stay(spark, tmp_path, monkeypatch):
    commits, publish, others = tables.Commits(spark, str(tmp_path / "c")), tables.publish, [5, 6]

    def slow(session, path, text):
        if others:  # another writer takes the version just before
            n = others.pop()
            tables.Commits(spark, commits.base).append(a=spark.range(n))
        return publish(session, path, text)

    monkeypatch.setattr(tables, "publish", slow)
    assert commits.append(a=spark.range(1)) == 3 and commits.read("a").count() == 12


def test_created_tasks_appear_with_their_games_and_events_or_not_at_all(spark, tmp_path):
    asked = spark.createDataFrame([(1, "A", "B", ["m/1", "m/2", "m/1"]), (2, "X", "B", ["m/1"]), (3, "A", "C", ["m/1", "?"]), (4, "A", " A ", ["m/1"])], "request_id long, start string, target string, model_ids array<string>")
    pages, models = spark.createDataFrame([("A",), ("B",)], "title string"), spark.createDataFrame([("m/1",), ("m/2",)], "id string")
    commits, at = tables.Commits(spark, str(tmp_path / "tasks")), F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    verdicts = {r.request_id: r.verdict for r in sessions.commit_tasks(commits, asked, pages, models, at).collect()}
    assert verdicts == {1: "created", 2: "page_not_found", 3: "invalid_model", 4: "same_page"}
    games, event = commits.read("games").orderBy("number").collect(), commits.read("events").first()
    assert [g.model_id for g in games] == ["m/1", "m/2", "m/1"] and len({g.game_id for g in games}) == 3 and all(g.game_id.startswith("m_") and "_20240506_070809_" in g.game_id for g in games)
    assert event.type == "task_selected" and all(f'"{g.game_id}"' in event.data for g in games) and commits.read("tasks").count() == 1
    broken = sessions.task_tables(asked, sessions.create_tasks(asked, pages, models), at)
    broken["events"] = broken["events"].withColumn("data", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        commits.append(**broken)
    assert commits.read("tasks").count() == 1 and commits.read("games").count() == 3


def test_states_look_up_distances_without_rows_for_pairs(spark, net, monkeypatch):
    """Targets are bits from the first aggregate on: what is written has a row a page and word, not one a pair; states keep their repeats and nulls, and of pages with one title the nearest counts."""
    edges, back = net
    pages = spark.createDataFrame([(k, f"P{k}") for k in range(300)] + [(400, "P7")], "page_id long, title string")
    rows = [(f"P{t}", f"P{k}", k) for t in range(70) for k in range(0, 300, 7)] * 2 + [("P5", "Nowhere", 0), ("Nowhere", "P5", 1), (None, "P5", 2)]
    states = spark.createDataFrame(rows, "target_page_title string, page_title string, move_index long")
    made, keep = {}, race.materialize
    monkeypatch.setattr(race, "materialize", lambda df, label: made.setdefault(label, keep(df, label)))
    got = race.with_distance(states, edges, pages)
    assert got.columns == ["target_page_title", "page_title", "move_index", "distance"]
    assert made["pages-in-use"].count() <= 2 * 45 and made["distances"].count() <= 2 * 44  # pairs in use are 3,013
    near = {f"P{t}": bfs(back, t) for t in range(70)}
    both = bfs(back, 400)
    near["P7"] = {n: min(near["P7"].get(n, 99), both.get(n, 99)) for n in {*near["P7"], *both}}  # a target of two pages is searched from both
    nodes = lambda p: [7, 400] if p == "P7" else [int(p[1:])]
    least = lambda t, p: min((near[t][n] for n in nodes(p) if n in near[t]), default=-1) if t in near and p != "Nowhere" else -1
    assert sorted((str(r[0]), r[1], r[2], -1 if r[3] is None else r[3]) for r in got.collect()) == sorted((str(t), p, k, least(t, p)) for t, p, k in rows)


def test_repeated_rows_of_a_kept_table_are_dropped_where_they_lie_together(spark):
    name = f"test-{random.random()}"
    rows = [(k % 5, k % 3) for k in range(60)]
    made = tables.kept(spark, name, lambda: spark.createDataFrame(rows, "a long, b long"), "a", distinct=True)
    assert sorted(map(tuple, made.df.collect())) == sorted(set(rows)) and tables.is_kept(spark, name) and not tables.is_kept(spark, name + "x")


def test_moves_are_ordered_by_all_that_shows(spark, tmp_path):
    """Lines that tie on number and part differ in nothing that moves show, so no other column is dealt."""
    from navgraph.sources import views

    lines = [(1, 2, 7, 1, 5.0), (1, 1, 9, 2, 1.0), (1, 2, 3, 1, 9.0), (1, 2, 7, 0, 4.0), (2, 1, 4, 1, 1.0)]
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"
    spark.createDataFrame(lines, kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted((r.game_id, r.step, r.from_page_title, r.to_page_title) for r in views.moves(spark, str(tmp_path)).collect())
    assert got == [("g1", 1, "ITEM_4", "ITEM_1"), ("g1", 2, "ITEM_1", "ITEM_3"), ("g1", 3, "ITEM_3", "ITEM_3")]
    assert sorted((r.pl_from, r.pl_target_id) for r in views.links_raw(spark, str(tmp_path)).collect()) == [(4, 80), (8, 80), (10, 40)]


def test_states_of_walks(spark, tmp_path):
    """Walks give the states of games and moves, and their distances, for lines that tie, parts that are missing and orders without lines."""
    spark.createDataFrame([(50, 1, 100), (50, 2, 7), (50, 2, 100), (1, 1, 5), (1, 2, None), (1, 3, 102), (2, 1, 8), (9, 1, 100)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 0, "O", None) for k in (50, 1, 2, 3)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k,) for k in (0, 2, 5, 7, 100, 102)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    games, pages = views.games(spark, str(tmp_path)), views.pages(spark, str(tmp_path))
    parts, edges = views.orders_parts(spark, str(tmp_path)), spark.createDataFrame([(8, 101), (1, 8), (6, 101)], "src_id long, dst_id long")
    plain = race.page_states(games, views.moves(spark, str(tmp_path)))
    walked = race.walked_with_distance(views.configs(spark, str(tmp_path)), views.walks_of(parts), views.title_of, edges, pages)
    columns = ["task_id", "game_id", "target_page_title", "move_index", "page_title", "distance"]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(walked.select(columns)) == rows(race.with_distance(plain, edges, pages).select(columns))
    assert {r.distance for r in walked.collect()} == {None, 0, 1, 2}
    assert rows(views.links_of(parts)) == rows(views.links_raw(spark, str(tmp_path)))


def test_windows_of_walked_states_deal_nothing(spark, sf_dir):
    """What is windowed by game is not dealt after states are made, where games and walks are too large to be broadcast."""
    df = play.distance_change(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[plan.index("Window") : plan.index("Generate")]
    assert "hashpartitioning(game_id" not in above


def test_visits_need_no_graph(spark, sf_dir, monkeypatch):
    def built(*_):
        raise AssertionError("a graph was built")

    monkeypatch.setattr(play, "graph", built)
    assert play.visit_histogram(spark, sf_dir).count() and play.node_sizes(spark, sf_dir).count()


def test_rings_are_read_off_states(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(race, "nodes", None)
    assert tasks.distance_rings(spark, sf_dir).count() == play.task_completion(spark, sf_dir).count()


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of the steps that a search writes, by label, with no side small enough for Spark to broadcast it by itself."""
    seen, real = defaultdict(list), paths.materialize

    def written(df, label, *more):
        seen[label].append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label, *more)

    monkeypatch.setattr(paths, "materialize", written)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_single_paths_send_few_nodes_to_the_edges(spark, net, plans):
    edges, back = net
    found = paths.connected(paths.single_paths(edges, spark.createDataFrame([(1, 400, 404), (2, 5, 9)], "query_id long, src_id long, dst_id long")), edges)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    grown = [p for p in plans["tree"] if "Join" in p]
    assert grown and all("BroadcastHashJoin" in p for p in grown)
    assert {r.query_id: (r.length, r.connected) for r in found.collect()}[1] == (4, True)


def test_walks_of_shortest_paths_send_few_paths_to_the_edges(spark, net, plans):
    edges, back = net
    found = paths.shortest_paths(edges, spark.createDataFrame([(1, 400, 402)], "query_id long, src_id long, dst_id long")).collect()
    assert [r.length for r in found] == [2] * len(found) and found
    walked = plans["paths"][1:]  # the first has the nodes in the middle
    assert walked and all("BroadcastHashJoin" in p for p in walked)


def test_degrees_of_few_pages_make_no_table(spark, net):
    edges, back = net
    store = GraphStore(None, None, edges, degrees=lambda: pytest.fail("all degrees are counted"))
    asked = spark.createDataFrame([(401,), (5,), (999,)], "page_id long")
    got = {r.page_id: (r.outgoing_count, r.incoming_count) for r in store.degrees_of(asked).collect()}
    pairs = [(a, b) for b, sources in back.items() for a in sources]
    want = {p: (sum(a == p for a, _ in pairs), sum(b == p for _, b in pairs)) for p in (401, 5)}
    assert got == {p: n for p, n in want.items() if n != (0, 0)}


def test_parents_are_read_off_walks_in_tasks_by_their_number(spark, sf_dir, monkeypatch):
    title = lambda stop: F.concat(F.lit("p"), stop.cast("string"))
    stops = {"a": [9, 5, None, 7, 5], "b": [9, 7, 5], "c": [9], "d": [], "e": None, "f": [None, None, 2, 6], "g10": [1, 3], "g9": [1, 4, 3], "h": [9, 2, 2, 8, 7]}
    games = [(g, f"p{k % 2}", "p7", k % 2) for k, g in enumerate([*stops, "none"])] + [(f"more{k}", "p1", "p7", 1) for k in range(60)]
    stops |= {f"more{k}": [0, 10 + k % 13, 30 + k % 7] for k in range(60)} | {"nobody": [1, 2]}
    games = spark.createDataFrame(games, "game_id string, start_page_title string, target_page_title string, start_stop long")
    walks = spark.createDataFrame(list(stops.items()), "game_id string, stops array<long>")
    want = {tuple(r) for r in race.parents(race.walked_states(games, walks, title)).collect()}
    found = race.walked_parents(games, walks, title)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str) and ("p1__to__p7", "p1", None) in want
    monkeypatch.setattr(race, "WALKS_A_TASK", 2)
    found = race.walked_parents(games, walks, title)
    assert {tuple(r) for r in found.collect()} == want and found.rdd.getNumPartitions() == 35
    assert "Window" not in play.parent_nodes(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
