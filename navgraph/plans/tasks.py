"""Queries on tasks and games that run: creation, events, prompts, caches, snapshots and monitoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from navgraph.operators import games as G
from navgraph.operators import sessions as S
from navgraph.operators import tasks as T
from navgraph.operators.snapshots import Snapshots
from navgraph.operators.store import pick_link
from navgraph.plans.graph import _DEGREES, GRAPH, graph, resolved, rows
from navgraph.plans.play import _MODELS, _NODES, _SEEN, VIEWS, _models, _nodes, _seen
from navgraph.plans.registry import query
from navgraph.session import numbered, shared_dir
from navgraph.sources import dumps as D
from navgraph.sources import views as V
from navgraph.sources.tables import Commits

_NOBODY = "nobody/none"


@query(_MODELS + f", few AS (SELECT min(id) AS id FROM models UNION ALL SELECT max(id) FROM models UNION ALL SELECT '{_NOBODY}') SELECT id, name FROM models WHERE id IN (SELECT id FROM few)")
def allowed_models(spark, sf_dir):
    models = _models(spark, sf_dir)
    few = models.agg(F.array(F.min("id"), F.max("id"), F.lit(_NOBODY)).alias("ids")).select(F.explode("ids").alias("id"))
    return S.allowed(models, few).select("id", "name")


@query(VIEWS + """, known AS (SELECT 'm' || c_custkey AS id, c_name AS model_name, lower(c_mktsegment) AS model_provider FROM customer WHERE c_custkey BETWEEN 0 AND 5)
SELECT game_id, model_id, model_name, model_provider FROM v_games LEFT JOIN known ON id = model_id""")
def players_with_models(spark, sf_dir):
    """Six of the eight models are in the catalogue."""
    c = V.table(spark, sf_dir, "customer").filter("c_custkey BETWEEN 0 AND 5")
    known = c.select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("provider"))
    return S.with_models(V.games(spark, sf_dir), known).select("game_id", "model_id", "model_name", "model_provider")


@query(VIEWS + " SELECT game_id, model_id, steps, status FROM v_games WHERE game_id = 'g7'")
def game_by_id(spark, sf_dir):
    return V.games(spark, sf_dir).filter("game_id = 'g7'").select("game_id", "model_id", "steps", "status")


_REQUESTS = [(1, "Item_0", "Item_7", "m1,m2"), (2, "Nowhere", "Item_7", "m1"), (3, "Item_1", "Item_7", "m1,unknown,m2"), (4, "Item_2", "Item_2", "m1"), (5, "Item_3", "Item_9", "m3,m3")]


@query(VIEWS + ", asked AS (SELECT * FROM (VALUES " + ", ".join(map(str, _REQUESTS)) + """) AS r(request_id, start, target, models)),
seats AS (SELECT request_id, unnest(string_split(models, ',')) AS model_id FROM asked),
fit AS (SELECT request_id, count(*) AS n, bool_and(model_id IN (SELECT DISTINCT model_id FROM v_games)) AS ok FROM seats GROUP BY 1),
judged AS (
  SELECT a.request_id, start, target, models, n, CASE WHEN start = target THEN 'same_page' WHEN start NOT IN (SELECT title FROM v_pages) THEN 'page_not_found' WHEN NOT ok THEN 'invalid_model' ELSE 'created' END AS verdict
  FROM asked a JOIN fit f ON f.request_id = a.request_id)
SELECT CAST(request_id AS BIGINT) AS request_id, verdict, CASE WHEN verdict = 'created' THEN start || '__to__' || target END AS task_id,
       CASE WHEN verdict = 'created' THEN models END AS players, CAST(CASE WHEN verdict = 'created' THEN n ELSE 0 END AS BIGINT) AS started FROM judged""")
def created_tasks(spark, sf_dir):
    asked = rows(spark, _REQUESTS, "request_id bigint,start string,target string,models string").withColumn("model_ids", F.split("models", ","))
    models = V.games(spark, sf_dir).select(F.col("model_id").alias("id")).distinct()
    made = S.create_tasks(asked, V.pages(spark, sf_dir), models)
    players = F.array_join(F.transform("players", lambda p: p["model_id"]), ",")
    return made.select(F.col("request_id").cast("long").alias("request_id"), "verdict", "task_id", players.alias("players"), F.coalesce(F.size("players"), F.lit(0)).cast("long").alias("started"))


@query(VIEWS + """ SELECT game_id, CAST(step AS BIGINT) AS seq, 'move_completed' AS type FROM v_moves WHERE game_id IN (SELECT game_id FROM v_games)
UNION ALL SELECT g.game_id, CAST(coalesce(max(m.step), 0) + 1 AS BIGINT), 'game_ended' FROM v_games g LEFT JOIN v_moves m ON m.game_id = g.game_id
WHERE status IN ('won', 'lost_max_steps', 'lost_invalid_move', 'error') GROUP BY g.game_id""")
def emitted_events(spark, sf_dir):
    return S.emitted(V.games(spark, sf_dir), V.moves(spark, sf_dir))


_TEMPLATE = "Start Page: '{start_page_title}', Target Page: '{target_page_title}'"


@query(VIEWS + " SELECT game_id, replace(replace('" + _TEMPLATE.replace("'", "''") + "', '{start_page_title}', start_page_title), '{target_page_title}', target_page_title) AS prompt FROM v_games")
def system_prompts(spark, sf_dir):
    games = V.games(spark, sf_dir)
    return games.select("game_id", S.system_prompt(F.lit(_TEMPLATE), F.col("start_page_title"), F.col("target_page_title")).alias("prompt"))


_OUT = """, lists AS (SELECT s.title, list(t.title ORDER BY t.title) AS links FROM edges e JOIN pruned s ON s.page_id = e.src_id JOIN pruned t ON t.page_id = e.dst_id GROUP BY s.title)"""


def _lists(spark, sf_dir):
    store = graph(spark, sf_dir)
    named = store.pages.select("page_id", "title")
    near = store.edges.join(named.withColumnRenamed("page_id", "src_id"), "src_id").join(named.select(F.col("page_id").alias("dst_id"), F.col("title").alias("link")), "dst_id")
    return near.groupBy("title").agg(F.sort_array(F.collect_list("link")).alias("links"))


@query(GRAPH + _OUT + """ SELECT title, 'You are now on the page ''' || title || '''.' || chr(10) || 'Here are the available links:' || chr(10) || '[' || array_to_string(list_transform(links, lambda x: '''' || x || ''''), ', ') || ']' AS prompt,
  list_contains(links, 'Item_5') AS to_item_5 FROM lists""")
def turn_prompts(spark, sf_dir):
    return _lists(spark, sf_dir).select("title", S.turn_prompt(F.col("title"), F.col("links")).alias("prompt"), S.is_link(F.col("links"), F.lit("Item_5")).alias("to_item_5"))


@query(GRAPH + _OUT + " SELECT title, 'Current Page: ' || title || chr(10) || 'Total Links: ' || len(links) || chr(10) || chr(10) || 'Available Links:' || chr(10) || array_to_string(links, chr(10)) AS page FROM lists")
def link_pages(spark, sf_dir):
    return _lists(spark, sf_dir).select("title", S.link_page(F.col("title"), F.col("links")).alias("page"))


@query(GRAPH + _OUT + """, every AS (SELECT DISTINCT p.title, coalesce(links, []) AS links FROM pruned p LEFT JOIN lists l ON l.title = p.title)
SELECT title, links[CAST('0x' || substr(md5('13|' || title || '|1'), 1, 8) AS BIGINT) % greatest(len(links), 1) + 1] AS page, CASE WHEN len(links) = 0 THEN 'model_no_tool_call' END AS error FROM every""")
def random_moves(spark, sf_dir):
    """What the random player does on each page in its first turn: a link by chance, or no call where there is none."""
    pages = graph(spark, sf_dir).pages.select("title").distinct().join(_lists(spark, sf_dir), "title", "left")
    links = F.coalesce("links", F.array().cast("array<string>"))
    return pages.select("title", pick_link(links, 13, F.col("title"), F.lit("1")).alias("page"), F.when(F.size(links) == 0, "model_no_tool_call").alias("error"))


@query(VIEWS + f""", r AS (SELECT game_id, data AS page_title, CAST(floor(value) AS BIGINT) AS length, ts, event_id FROM v_events WHERE type = 'shortest_paths_found' AND game_id IS NOT NULL),
ends AS (SELECT game_id, max(ts) AS e FROM v_events WHERE type = 'game_ended' GROUP BY 1),
held AS (SELECT r.*, row_number() OVER (PARTITION BY r.game_id, page_title ORDER BY ts DESC, event_id DESC) AS n FROM r LEFT JOIN ends USING (game_id) WHERE e IS NULL OR ts > e)
SELECT game_id, page_title, length, event_id FROM held WHERE n = 1""")
def replayed_results(spark, sf_dir):
    """The solver results that hold at the end, by snapshots on two days: a viewer who left after the first gets what has changed since."""
    kinds = F.col("type").isin("shortest_paths_found", "game_ended")
    end = F.col("type") == "game_ended"
    rows_ = V.events(spark, sf_dir).filter(kinds & F.col("game_id").isNotNull()).select(
        "game_id", F.when(~end, F.col("data")).alias("page_title"), F.when(~end, F.floor("value")).alias("length"), F.when(~end, F.array("data")).alias("paths"), F.col("ts").alias("at"), "event_id", end.alias("ended")
    )
    shots = Snapshots(Commits(spark, f"{shared_dir(spark)}/navgraph/results-{uuid.uuid4().hex}"))
    first, last = rows_.agg((F.min("at") + (F.max("at") - F.min("at")) / 2), F.max("at")).first()
    left = shots.advance(rows_, first)
    seen = shots.state(left)
    shots.advance(rows_, last)
    return shots.caught_up(seen, left).select("game_id", "page_title", "length", "event_id")


@query(VIEWS + """ SELECT game_id, pos, concat_ws(',', CASE WHEN input_tokens IS NULL THEN 'page' END, CASE WHEN length(content) % 2 = 0 THEN 'reason' END) AS missing FROM v_messages""")
def missing_arguments(spark, sf_dir):
    """A message names a page if it has metrics, and a reason if its length is odd."""
    given = F.map_filter(F.create_map(F.lit("page"), F.col("input_tokens").isNotNull(), F.lit("reason"), F.length("content") % 2 == 1), lambda _, v: v)
    return V.messages(spark, sf_dir).select("game_id", "pos", F.array_join(S.missing_arguments(["page", "reason"], given), ",").alias("missing"))


@query(VIEWS + " SELECT DISTINCT model_id, 'max_tokens=' || (CASE WHEN model_id IN ('m1', 'm3') THEN '99' ELSE '10' END) || ';temperature=0.7' || (CASE WHEN model_id = 'm3' THEN ';top=1' ELSE '' END) AS settings FROM v_games")
def merged_settings(spark, sf_dir):
    models = V.games(spark, sf_dir).select("model_id").distinct()
    text = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    over = F.when(F.col("model_id") == "m1", text("max_tokens", "99")).when(F.col("model_id") == "m3", text("max_tokens", "99", "top", "1")).otherwise(F.expr("CAST(map() AS map<string,string>)"))
    merged = S.merged_settings(text("max_tokens", "10", "temperature", "0.7"), over)
    shown = F.transform(F.sort_array(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return models.select("model_id", F.array_join(shown, ";").alias("settings"))


@query(_SEEN + ", cache AS (SELECT game_id, page_title, arg_max_null(distance, move_index) AS distance FROM seen GROUP BY 1, 2) SELECT * FROM cache WHERE distance IS NOT NULL")
def solver_cache(spark, sf_dir):
    return S.solver_cache(_seen(spark, sf_dir))


@query(_SEEN + """, cache AS (SELECT game_id, page_title, arg_max_null(distance, move_index) AS distance FROM seen GROUP BY 1, 2),
r AS (SELECT game_id, string_agg(page_title || '=' || distance, ',' ORDER BY page_title) AS results FROM cache WHERE distance IS NOT NULL GROUP BY 1)
SELECT g.game_id, status, CAST(steps AS BIGINT) AS steps, coalesce(results, '') AS results FROM v_games g LEFT JOIN r ON r.game_id = g.game_id""")
def complete_states(spark, sf_dir):
    found = S.complete_states(V.games(spark, sf_dir), S.solver_cache(_seen(spark, sf_dir)))
    shown = F.transform("solver_results", lambda x: F.concat(x["page_title"], F.lit("="), x["distance"].cast("string")))
    return found.select("game_id", "status", F.col("steps").cast("long").alias("steps"), F.array_join(shown, ",").alias("results"))


@query(VIEWS + """ SELECT game_id, event_id, coalesce(last_value(CASE WHEN type = 'shortest_paths_found' THEN data END IGNORE NULLS) OVER (
  PARTITION BY game_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS latest FROM v_events""")
def latest_optimal_paths(spark, sf_dir):
    found = F.when(F.col("type") == "shortest_paths_found", F.array("data")).otherwise(F.expr("CAST(array() AS array<string>)"))
    return S.latest_paths(V.events(spark, sf_dir).withColumn("paths", found), ["ts"]).select("game_id", "event_id", F.array_join("latest", ",").alias("latest"))


@query(VIEWS + """, r AS (SELECT game_id % 20 AS task_id, ts, data AS page_title, CAST(floor(value) AS BIGINT) % 4 AS length FROM v_events WHERE type = 'shortest_paths_found'),
starts AS (SELECT game_id % 20 AS task_id, min(data) AS start FROM v_events WHERE type = 'task_selected' GROUP BY 1)
SELECT r.task_id, arg_min(length, ts) AS length FROM r JOIN starts s ON s.task_id = r.task_id AND s.start = r.page_title WHERE length > 0 GROUP BY 1""")
def task_lengths(spark, sf_dir):
    """The first length known of each task, from results on its start page, which the events' data stand for."""
    task, e = (F.col("game_id") % 20).alias("task_id"), V.events(spark, sf_dir)
    starts = e.filter("type = 'task_selected'").groupBy(task).agg(F.min("data").alias("start_page_title"))
    found = e.filter("type = 'shortest_paths_found'")
    return S.task_lengths(found.select(task, F.col("ts").alias("at"), F.col("data").alias("page_title"), (F.floor("value") % 4).alias("length")), starts)


_PLAYERS = VIEWS + ", players AS (SELECT game_id % 20 AS task_id, game_id, bool_or(type = 'game_ended') AS ended FROM v_events GROUP BY 1, 2)"


def _players(spark, sf_dir):
    e = V.events(spark, sf_dir)
    return e.groupBy((F.col("game_id") % 20).alias("task_id"), "game_id").agg(F.bool_or(F.col("type") == "game_ended").alias("ended"))


@query(_PLAYERS + " SELECT task_id, string_agg(CAST(game_id AS VARCHAR), ',' ORDER BY game_id) AS games FROM players WHERE NOT ended GROUP BY 1")
def active_tasks(spark, sf_dir):
    return S.active_tasks(_players(spark, sf_dir)).select("task_id", F.array_join(F.col("games").cast("array<string>"), ",").alias("games"))


@query(_PLAYERS + " SELECT count(DISTINCT game_id) AS active_games, count(DISTINCT task_id) AS active_tasks, (SELECT count(*) FROM v_events WHERE type = 'task_selected') AS connections FROM players WHERE NOT ended")
def monitoring_counts(spark, sf_dir):
    return S.monitoring(_players(spark, sf_dir), V.events(spark, sf_dir).filter("type = 'task_selected'").select("game_id"))


@query(VIEWS + " SELECT game_id, count(*) AS connections FROM v_events WHERE type = 'task_selected' GROUP BY game_id")
def viewers_by_game(spark, sf_dir):
    return S.viewers_by_game(V.events(spark, sf_dir).filter("type = 'task_selected'"))


@query(VIEWS + " SELECT count(*) AS events, count(*) FILTER (type = 'move_completed') AS moves FROM (SELECT CASE WHEN event_id % 7 <> 3 THEN type END AS type FROM v_events) WHERE type IS NOT NULL")
def well_formed_events(spark, sf_dir):
    """Of events of which one in seven lost its type."""
    e = V.events(spark, sf_dir).withColumn("type", F.when(F.col("event_id") % 7 != 3, F.col("type")))
    return S.well_formed(e).agg(F.count("*").alias("events"), F.count_if(F.col("type") == "move_completed").alias("moves"))


@query(VIEWS + """, runs AS (SELECT game_id, bool_or(type = 'game_ended') AS success, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds FROM v_events GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(seconds), 6) AS avg_duration, min(seconds) AS min_duration, max(seconds) AS max_duration,
  CAST(sum(seconds) AS BIGINT) AS total_duration FROM runs""")
def run_durations(spark, sf_dir):
    runs = V.events(spark, sf_dir).groupBy("game_id").agg(F.bool_or(F.col("type") == "game_ended").alias("success"), F.timestamp_diff("SECOND", F.date_trunc("second", F.min("ts")), F.date_trunc("second", F.max("ts"))).alias("seconds"))
    return S.durations(runs).withColumns({c: F.round(c, 6) for c in ("success_rate", "avg_duration")})


@query(_NODES + " SELECT task_id, CAST(max(distance) AS BIGINT) AS max_distance, array_to_string(range(1, CAST(max(distance) AS BIGINT) + 3), ',') AS rings FROM nodes WHERE distance IS NOT NULL GROUP BY 1")
def distance_rings(spark, sf_dir):
    """A task's farthest node is its farthest state; its target, a node at distance 0, stands in for states without a distance."""
    found = S.rings(_seen(spark, sf_dir).select("task_id", F.coalesce("distance", F.lit(0)).alias("distance")))
    return found.select("task_id", F.col("max_distance").cast("long").alias("max_distance"), F.array_join(F.col("rings").cast("array<string>"), ",").alias("rings"))


_KINDS = list(S.STRATEGIES)


@query(VIEWS + f""", asked AS (SELECT game_id, [{", ".join(f"'{k}'" for k in _KINDS)}][CAST(substr(game_id, 2) AS BIGINT) % {len(_KINDS)} + 1] AS strategy,
  CASE WHEN steps % 2 = 0 THEN start_page_title ELSE ' ' END AS s, CASE WHEN steps % 3 = 0 THEN target_page_title END AS t FROM v_games)
SELECT game_id, strategy, CASE strategy WHEN 'random' THEN 'Randomly selected from en Wikipedia' WHEN 'custom' THEN 'User-specified task with validation and random fallback' END AS description,
  CASE WHEN strategy = 'custom' THEN CASE WHEN s <> ' ' THEN s ELSE 'random' END END AS start_page, CASE WHEN strategy = 'custom' THEN coalesce(t, 'random') END AS target_page FROM asked""")
def strategies(spark, sf_dir):
    """What is told of the strategy of each game, which takes its turn among all; pages are given to some."""
    games = V.games(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.substring("game_id", 2, 20).cast("long") % len(_KINDS) + 1).cast("int"))
    start, target = F.when(F.col("steps") % 2 == 0, F.col("start_page_title")).otherwise(" "), F.when(F.col("steps") % 3 == 0, F.col("target_page_title"))
    asked = games.select("game_id", kind.alias("strategy"), start.alias("s"), target.alias("t"))
    return asked.select("game_id", "strategy", *S.strategy_columns(F.col("strategy"), F.lit("en"), F.col("s"), F.col("t")))


_ASKED_TASKS = VIEWS + f""", asked AS (
  SELECT start_page_title AS s, target_page_title AS t, list_sort(list_distinct(list(model_id))) AS models, CAST(regexp_extract(start_page_title, '[0-9]+') AS BIGINT) AS k FROM v_games GROUP BY 1, 2),
made AS (SELECT s, t, k, models FROM asked WHERE k % 7 <> 3 AND k % 11 <> 5)"""


@query(_ASKED_TASKS + """ SELECT s || '__to__' || t AS task_id, CAST(len(models) AS BIGINT) AS games, array_to_string(models, ',') AS models, CAST(1 AS BIGINT) AS selected, CAST(len(models) AS BIGINT) AS told FROM made""")
def committed_tasks(spark, sf_dir):
    """Each task of the games as a request, some of them with a page or a model that isn't known, committed in two parts and read again."""
    games, key = V.games(spark, sf_dir), F.regexp_extract("start", "[0-9]+", 0).cast("long")
    asked = games.groupBy(F.col("start_page_title").alias("start"), F.col("target_page_title").alias("target")).agg(F.sort_array(F.collect_set("model_id")).alias("model_ids"))
    asked = asked.withColumns({"request_id": key, "model_ids": F.when(key % 7 == 3, F.concat("model_ids", F.array(F.lit(_NOBODY)))).otherwise(F.col("model_ids"))})
    asked = asked.withColumn("start", F.when(key % 11 == 5, F.lit("Nowhere")).otherwise(F.col("start")))
    models = games.select(F.col("model_id").alias("id")).distinct()
    commits = Commits(spark, f"{shared_dir(spark)}/navgraph/tasks-{uuid.uuid4().hex}")
    for half in (0, 1):
        S.commit_tasks(commits, asked.filter(F.col("request_id") % 2 == half), V.pages(spark, sf_dir), models, F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    version = commits.version()
    games = commits.read("games", version).groupBy("task_id").agg(F.countDistinct("game_id").alias("games"), F.array_join(F.sort_array(F.collect_list("model_id")), ",").alias("models"))
    told = F.size(F.from_json("data", "game_ids array<string>")["game_ids"])
    events = commits.read("events", version).groupBy(F.col("game_id").alias("task_id")).agg(F.count_if(F.col("type") == "task_selected").alias("selected"), F.sum(told).cast("long").alias("told"))
    return commits.read("tasks", version).select("task_id").join(games, "task_id").join(events, "task_id")


@query(GRAPH + " SELECT source_id, target_id, row_number() OVER (ORDER BY source_id) AS pos FROM resolved")
def sorted_redirects(spark, sf_dir):
    """Resolved redirects in the order of their source, which ``pos`` shows."""
    return numbered(resolved(spark, sf_dir), ["source_id"], "pos")


@query(GRAPH + " SELECT src_id AS page_id, string_agg(CAST(dst_id AS VARCHAR), '|' ORDER BY CAST(dst_id AS VARCHAR)) AS ids FROM edges GROUP BY 1")
def grouped_out_by_text(spark, sf_dir):
    """The links of each page as a sort by whole lines leaves them: in the order of their digits."""
    return graph(spark, sf_dir).edges.groupBy(F.col("src_id").alias("page_id")).agg(F.array_join(F.sort_array(F.collect_list(F.col("dst_id").cast("string"))), "|").alias("ids"))


@query(VIEWS + " SELECT DISTINCT title, replace(url_encode(replace(title, '_', ' ')), '+', '%20') AS encoded FROM v_pages")
def encoded_titles(spark, sf_dir):
    return V.pages(spark, sf_dir).select("title", F.replace(F.url_encode(F.replace("title", F.lit("_"), F.lit(" "))), F.lit("+"), F.lit("%20")).alias("encoded")).distinct()


@query(GRAPH + f""", {_DEGREES}, c AS (
  SELECT p.page_id, p.title, row_number() OVER (ORDER BY md5('11|' || p.page_id), p.page_id) AS n FROM pruned p WHERE namespace = 0 AND NOT is_redirect),
k AS (SELECT c.n, c.title, coalesce(outgoing_count, 0) AS o, coalesce(incoming_count, 0) AS i FROM c LEFT JOIN degrees d ON d.page_id = c.page_id WHERE n <= 20)
SELECT (SELECT title FROM k WHERE o > 0 AND title <> 'Item_10' ORDER BY n LIMIT 1) AS start_page_title, 'Item_10' AS target_page_title
WHERE EXISTS (SELECT 1 FROM pruned p JOIN degrees d ON d.page_id = p.page_id WHERE p.title = 'Item_10' AND incoming_count > 0)""")
def filled_task(spark, sf_dir):
    """A task of a given target and a start that is filled in."""
    store = graph(spark, sf_dir)
    return T.custom_task(store.pages, store.degrees, 11, target="Item_10")


@query(VIEWS + " SELECT game_id, status, CAST(steps AS BIGINT) AS steps, start_page_title AS start_page, max_steps FROM v_games WHERE status IN ('won', 'lost_max_steps')")
def stored_summaries(spark, sf_dir):
    """Games that are kept, written to JSON lines and, as a summary with a header, to CSV, and read from both."""
    games = V.games(spark, sf_dir)
    kept = games.filter(G.storable(F.col("status"), F.expr("CAST(array() AS array<string>)"), store_failed=False))
    base = f"{shared_dir(spark)}/navgraph/summaries-{uuid.uuid4().hex}"
    config = F.struct("start_page_title", "target_page_title", F.col("max_steps").cast("int").alias("max_steps"))
    D.append_games(kept.select("game_id", "model_id", config.alias("config"), "status", F.col("steps").cast("int").alias("steps"), F.col("start_timestamp").cast("timestamp_ntz").alias("start_timestamp")), f"{base}/games")
    good, _ = D.read_games(spark, f"{base}/games")
    D.write_summary(good, f"{base}/summary")
    back = spark.read.option("header", True).csv(f"{base}/summary")
    return back.select("game_id", "status", F.col("steps").cast("long").alias("steps"), "start_page", F.col("max_steps").cast("int").alias("max_steps"))
