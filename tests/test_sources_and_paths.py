"""Dump files in splits, the order of lines, single paths, snapshots, and branches that tables don't reach."""

from __future__ import annotations

import datetime
import gzip
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from navgraph.functions.titles import is_page_id, is_title
from navgraph.operators import games, links, paths, race, ratings, sessions, snapshots, tasks
from navgraph.operators.store import pick_link
from navgraph.sources import dumps
from navgraph.sources.tables import Commits

TITLES = ["A", "Farmers' market", "back\\slash", "x),(1,2,'y'),(", "semi;colon", "Ünï", 'a "b"', ""]


def sql_text(t):
    return "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"


@pytest.mark.parametrize("packed", [False, True])
def test_dump_files_in_many_splits(spark, tmp_path, packed):
    rows = [(k, k % 3, f"{TITLES[k % len(TITLES)]}{k}", k % 2) for k in range(1, 1501)]
    tuples = [f"({i},{n},{sql_text(t)},{r},0.5,NULL)" for i, n, t, r in rows]
    lines = [f"INSERT INTO `page` VALUES {','.join(tuples[k : k + 20])};" for k in range(0, 1500, 20)]
    text = "\n".join(["-- dump", "", *lines[:40], "INSERT INTO `page` VALUES (7,'no number'),(8,0,'fine',1,0);", "LOCK TABLES `page` WRITE;", *lines[40:]])
    path = tmp_path / ("page.sql.gz" if packed else "page.sql")
    path.write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found, rejects = dumps.read_dump(spark, str(path), "page", ordered=True)
        assert found.rdd.getNumPartitions() > 5 or packed
        got = found.orderBy("_order").collect()
        assert sorted(r.value for r in rejects.collect()) == ["7,'no number'", "LOCK TABLES `page` WRITE;"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    raw = lambda t: sql_text(t)[1:-1]
    want = [(i, n, raw(t), r) for i, n, t, r in rows]
    want.insert(800, (8, 0, "fine", 1))
    assert [(r.page_id, r.namespace, r.title, r.is_redirect) for r in got] == want  # in the order of the file


def test_written_dumps_and_stages_are_read_again(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 3, t, k % 2) for k, t in enumerate(TITLES)], "page_id long, namespace int, title string, is_redirect int").repartition(3)
    values = df.select(*[F.col(c).cast("string") for c in ("page_id", "namespace")], dumps.quoted("title"), F.col("is_redirect").cast("string"), F.lit("0.1"))
    dumps.write_dump(values, dumps.PAGE, str(tmp_path / "d"), tuples_a_line=2)
    found, rejects = dumps.read_dump(spark, str(tmp_path / "d"), "page")
    stored = {(r.page_id, r.title) for r in found.collect()}
    assert stored == {(k, sql_text(t)[1:-1]) for k, t in enumerate(TITLES)} and rejects.isEmpty()
    dumps.write_tsv(found, str(tmp_path / "t"))
    back, bad = dumps.read_tsv(spark, str(tmp_path / "t"), found.schema)
    assert {(r.page_id, r.title) for r in back.collect()} == stored and bad.isEmpty()
    every = dumps.read_tsv_all(spark, str(tmp_path / "t"), found.schema.add("more", "long"))
    assert every.count() == len(TITLES) and every.filter("page_id IS NOT NULL").isEmpty()


def test_the_last_line_of_a_title_wins(spark, tmp_path):
    """Pages 9 and 4 share a title, and 4 comes last; source 1 has two redirects."""
    (tmp_path / "page.sql").write_text("\n".join(f"INSERT INTO `page` VALUES ({i},0,'{t}',{r},0);" for i, t, r in [(1, "R", 1), (2, "S", 1), (9, "T", 0), (5, "U", 0), (4, "T", 0)]))
    (tmp_path / "redirect.sql").write_text("INSERT INTO `redirect` VALUES (1,0,'T','',''),(2,0,'T','',''),(1,0,'U','',''),(77,0,'T','','');")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        read = lambda ordered: [dumps.read_dump(spark, str(tmp_path / f"{n}.sql"), n, ordered=ordered)[0] for n in ("redirect", "page")]
        assert {r.source_id: r.target_id for r in links.redirect_ids(*read(True)).collect()} == {1: 5, 2: 4}
        assert {r.source_id: r.target_id for r in links.redirect_ids(*read(False)).collect()} == {1: 9, 2: 9}
        game = lambda i, steps: json.dumps({"game_id": i, "model_id": "m", "config": {"start_page_title": "A", "target_page_title": "B", "max_steps": 3}, "status": "won", "steps": steps})
        (tmp_path / "g.jsonl").write_text("\n".join([game("a", 9), game("b", 1), "broken", game("a", 2), game("b", 8)]))
        good, _ = dumps.read_games(spark, str(tmp_path / "g.jsonl"), ordered=True)
        assert {r.game_id: r.steps for r in games.latest(good, "_order").collect()} == {"a": 2, "b": 8}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_reasons_of_skipped_links(spark):
    found = links.skip_reasons(
        spark.createDataFrame([(1, 10), (1, 20), (1, 30), (9, 10), (None, 10), (1, None), (None, None)], "pl_from long, pl_target_id long"),
        spark.createDataFrame([(10, 0, "A"), (20, 0, "Red")], "lt_id long, namespace int, title string"),
        spark.createDataFrame([(1, 0, "A")], "page_id long, namespace int, title string"),
    )
    assert {r.reason: r.n for r in found.collect()} == {"ok": 1, "red_link": 1, "unknown_target": 1, "missing_source": 1, "malformed": 3}


def test_single_paths(spark):
    rng = random.Random(8)
    pairs = {(rng.randrange(120), rng.randrange(120)) for _ in range(260)} | {(k, k + 1) for k in range(200, 230)}
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    edges = spark.createDataFrame(sorted(pairs), "src_id long, dst_id long")
    asked = [(q, rng.randrange(120), rng.randrange(120)) for q in range(40)] + [(90, 200, 210), (91, 200, 211), (92, 5, 5), (93, 5, 999), (94, 230, 200)]

    def length(a, b):
        seen, front, n = {a}, [a], 0
        while front and b not in seen:
            front = [y for x in front for y in out[x] if y not in seen and not seen.add(y)]
            n += 1
        return n if b in seen else None

    found = paths.connected(paths.single_paths(edges, spark.createDataFrame(asked, "query_id long, src_id long, dst_id long")), edges).collect()
    got = {r.query_id: r for r in found}
    want = {q: n for q, a, b in asked if (n := length(a, b)) is not None and n <= 10}
    assert len(found) == len(got) and {q: r.length for q, r in got.items()} == want and 90 in got and 91 not in got
    assert all(r.connected and r.path[0] == a and r.path[-1] == b for q, a, b in asked if (r := got.get(q)))
    wrong = spark.createDataFrame([(1, [200, 201, 203]), (2, [200, 201]), (3, [7]), (4, [201, 200])], "query_id long, path array<long>")
    assert {r.query_id: r.connected for r in paths.connected(wrong, edges).collect()} == {1: False, 2: True, 3: True, 4: False}


RESULT = "game_id long, page_title string, length long, paths array<string>, at timestamp, event_id long, ended boolean"


def test_a_snapshot_and_what_comes_later_give_the_whole(spark, tmp_path):
    rng, rows, t0 = random.Random(2), [], datetime.datetime(2024, 1, 1)
    for i in range(200):
        ended, page = rng.random() < 0.06, rng.choice("ABCDE")
        rows.append((rng.randrange(6), None if ended else page, None if ended else rng.randrange(9), None if ended else [page, str(i)], t0 + datetime.timedelta(minutes=i // 2), i, ended))
    df = spark.createDataFrame(rows, RESULT)
    held: dict = {}
    for g, page, n, way, _, i, ended in rows:
        if ended:
            held = {k: v for k, v in held.items() if k[0] != g}
        else:
            held[g, page] = (n, way, i)
    shown = lambda d: {(r.game_id, r.page_title): (r.length, r.paths, r.event_id) for r in d.collect()}
    assert shown(snapshots.live_results(df)) == held
    shots, states = snapshots.Snapshots(Commits(spark, str(tmp_path / "s"))), {}
    assert shots.state() is None and shots.upto() is None
    for minutes in (20, 21, 55, 100):
        version = shots.advance(df, t0 + datetime.timedelta(minutes=minutes))
        states[version] = shots.state(version)
    assert [shown(shots.caught_up(state, version)) for version, state in states.items()] == [held] * 4
    assert shots.changes(2, 3).count() == 68 and shots.changes(4) is None and shots.upto() == t0 + datetime.timedelta(minutes=100)
    one = snapshots.complete(spark.createDataFrame([(0, "won", 3), (77, "error", 0)], "game_id long, status string, steps int"), shots.state()).collect()
    own = {r.game_id: [(x.page_title, x.length, x.paths) for x in r.solver_results] for r in one}
    assert own[77] == [] and own[0] == [(p, n, w) for (g, p), (n, w, _) in sorted(held.items()) if g == 0]


def test_prompts_show_lists_of_texts(spark):
    titles = ["Plain", "Farmers' market", 'The "quoted"', "both ' and \"", "back\\slash", "b\\'"]
    row = spark.createDataFrame([(titles, "of {target_page_title}", "{start_page_title}!")], "links array<string>, s string, t string").select(
        sessions.turn_prompt(F.lit("T"), F.col("links")).alias("p"), sessions.system_prompt(F.lit("{start_page_title} to {target_page_title}, {start_page_title}"), F.col("s"), F.col("t")).alias("q")
    ).first()
    assert row.p == f"You are now on the page 'T'.\nHere are the available links:\n{titles}"
    assert row.q == "of {target_page_title} to {start_page_title}!, of {target_page_title}"


def test_branches_that_tables_do_not_reach(spark, tmp_path):
    models = spark.createDataFrame([("google/gem", "Gem", 3, 1e-6, 0.0), ("x-ai/g2", "G", None, None, None), ("Other/gem", "O", 1, 0.0, 0.0)], "id string, name string, created long, prompt_price double, completion_price double")
    info = tasks.model_info(models)
    assert [(r.id, r.icon, r.created) for r in info.collect()] == [("google/gem", "gemini", 3), ("Other/gem", "other", 1), ("x-ai/g2", "grok", 0)]
    assert [r.id for r in tasks.search_models(info, "GEM", without=("Other/gem",)).collect()] == ["google/gem"]
    (tmp_path / "b.json").write_text(json.dumps({"data": [{"id": "p/a", "name": "A", "created": 1}]}))
    read = lambda *names, **more: sorted(r.id for r in dumps.read_catalogue(spark, *[str(tmp_path / n) for n in names], **more).collect())
    assert read("a.json", "b.json", chance=True) == ["local/random", "p/a"] and read("a.json") == [] and read("b.json") == ["p/a"]
    assert tasks.task_space(spark.createDataFrame([], "page_id long, namespace int, is_redirect boolean")).first().tasks == 7_000_000**2
    states = spark.createDataFrame([("t", "g", "B", 0, "A", 2), ("t", "g", "B", 1, "C", 1)], "task_id string, game_id string, target_page_title string, move_index int, page_title string, distance int")
    shown = race.nodes(states, spark.createDataFrame([("t", "C"), ("t", "D"), ("t", "B")], "task_id string, page_title string"))
    assert {r.page_title: (r.kind, r.visits, r.radius) for r in shown.collect()} == {"A": ("start", 1, 20.0), "B": ("target", 0, 30.0), "C": ("visited", 1, 15.0), "D": ("optimal", 0, 15.0)}
    chosen = spark.range(300).select(pick_link(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, F.col("id").cast("string")).alias("x"), pick_link(F.array().cast("array<string>"), 1, F.lit("k")).alias("none"))
    counts = {r.x: r["count"] for r in chosen.groupBy("x").count().collect()}
    assert set(counts) == {"a", "b", "c"} and min(counts.values()) > 70 and chosen.filter("none IS NOT NULL").isEmpty()
    ids = spark.createDataFrame([(1, "a"), (0, ""), (-1, " "), (None, None)], "i long, t string").select(is_page_id(F.col("i")).alias("i"), is_title(F.col("t")).alias("t")).collect()
    assert [(r.i, r.t) for r in ids] == [(True, True), (False, False), (False, True), (False, False)]
    assert ratings.elo(spark.createDataFrame([("m", 0.0), ("n", 1.0)], "model string, strength double")).orderBy("model").first().rating == -2400


def test_the_first_length_is_that_of_the_start_page(spark):
    rows = [("t", 1, "B", 7), ("t", 2, "A", 0), ("t", 3, "A", 4), ("t", 4, "A", 5), ("u", 1, "B", 2)]
    results = spark.createDataFrame(rows, "task_id string, at int, page_title string, length int")
    starts = spark.createDataFrame([("t", "A"), ("u", "A")], "task_id string, start_page_title string")
    assert {r.task_id: r.length for r in sessions.task_lengths(results, starts).collect()} == {"t": 4}
    assert {r.task_id: r.length for r in sessions.task_lengths(results).collect()} == {"t": 7, "u": 2}
