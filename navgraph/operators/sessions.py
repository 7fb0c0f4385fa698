"""Running games: creating tasks, prompts, emitted events, snapshots, caches and what is shown of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navgraph.functions.titles import game_id, task_id
from navgraph.operators.games import FINISHED
from navgraph.session import materialize
from navgraph.sources.tables import Commits

# Who gets which events, and the strategies with their descriptions.
SUBSCRIPTIONS = (
    ("task_selected", "solver"), ("task_solved", "task_coordinator"), ("task_solved", "websocket"), ("move_completed", "websocket"), ("move_completed", "solver"), ("shortest_paths_found", "websocket"),
    ("game_ended", "websocket"), ("game_ended", "storage"), ("game_ended", "task_coordinator"), ("game_ended", "solver"), ("task_ended", "websocket"),
)
STRATEGIES = {"random": "Randomly selected from {language} Wikipedia", "custom": "User-specified task with validation and random fallback", "ranked": None, "themed": None, "campaign": None, "tournament": None}


def strategy_columns(kind: Column, language: Column, start: Column, target: Column) -> list[Column]:
    """description, start_page and target_page as ``strategy_info`` has them, of rows; null for a strategy that nothing selects tasks by, and pages for ``custom`` only."""
    texts = F.create_map(*[F.lit(x) for k, text in STRATEGIES.items() if text for x in (k, text)])
    page = lambda c: F.when(kind == "custom", F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("random")))
    return [F.replace(texts[kind], F.lit("{language}"), language).alias("description"), page(start).alias("start_page"), page(target).alias("target_page")]


def strategy_info(kind: str, language: str = "en", start: str | None = None, target: str | None = None) -> dict[str, str] | None:
    """What is told of a strategy; None for one that nothing selects tasks by."""
    text = STRATEGIES.get(kind)
    if text is None:
        return None
    info = {"strategy": kind, "language": language, "description": text.format(language=language)}
    return info | {"start_page": start or "random", "target_page": target or "random"} if kind == "custom" else info


def allowed(models: DataFrame, ids: DataFrame) -> DataFrame:
    """The models whose id is in the list ``ids``."""
    return models.join(ids.select("id").distinct(), "id", "left_semi")


def with_models(games: DataFrame, models: DataFrame) -> DataFrame:
    """Games with name and provider of their model, null where it isn't known."""
    return games.join(models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), F.col("provider").alias("model_provider")), "model_id", "left")


def create_tasks(requests: DataFrame, pages: DataFrame, models: DataFrame) -> DataFrame:
    """request_id, task_id, verdict, players (array of game number and model_id) of requests (request_id, start, target, model_ids).

    A request is all or nothing: without its start page (``page_not_found``) or
    with a model that isn't known (``invalid_model``) no game of it is made;
    what was set up before the failure is taken back. Equal pages are ``same_page``.
    """
    known = pages.select(F.col("title").alias("start")).distinct().withColumn("found", F.lit(True))
    asked = requests.select("request_id", F.posexplode("model_ids").alias("i", "model_id")).join(models.select(F.col("id").alias("model_id"), F.lit(True).alias("ok")), "model_id", "left")
    seats = asked.groupBy("request_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("fit"), F.sort_array(F.collect_list(F.struct((F.col("i") + 1).alias("number"), "model_id"))).alias("players"))
    verdict = F.when(F.trim("start") == F.trim("target"), "same_page").when(F.col("found").isNull(), "page_not_found").when(~F.coalesce("fit", F.lit(True)), "invalid_model").otherwise("created")
    rows = requests.join(known, "start", "left").join(seats, "request_id", "left").withColumn("verdict", verdict)
    made = F.col("verdict") == "created"
    return rows.select("request_id", F.when(made, task_id(F.col("start"), F.col("target"))).alias("task_id"), "verdict", F.when(made, F.col("players")).alias("players"))


def task_tables(requests: DataFrame, created: DataFrame, at: Column) -> dict[str, DataFrame]:
    """tasks, games and events (task_selected) that the created ones of ``requests`` come to, as of the time ``at``.

    A game's id is of its model, the time, and four letters that request and
    seat decide, so a commit that is tried again makes the same ids.
    """
    made = created.filter("verdict = 'created'").join(requests.select("request_id", "start", "target"), "request_id").withColumn("at", at)
    suffix = F.substring(F.md5(F.concat_ws("|", F.col("request_id").cast("string"), F.col("p.number").cast("string"))), 1, 4)
    seats = made.select("request_id", "task_id", "start", "target", "at", F.explode("players").alias("p"))
    games = seats.select("request_id", "task_id", game_id(F.col("p.model_id"), F.col("at"), suffix).alias("game_id"), F.col("p.model_id").alias("model_id"), F.col("p.number").alias("number"), F.col("start").alias("start_page_title"), F.col("target").alias("target_page_title"), F.lit("not_started").alias("status"))
    players = games.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("number", "game_id"))).alias("g"))
    data = F.to_json(F.struct(F.col("start").alias("start_page_title"), F.col("target").alias("target_page_title"), F.col("g.game_id").alias("game_ids")))
    events = made.join(players, "request_id").select(F.lit("task_selected").alias("type"), F.col("task_id").alias("game_id"), data.alias("data"), F.col("at").alias("timestamp"))
    return {"tasks": made.select("request_id", "task_id", F.col("start").alias("start_page_title"), F.col("target").alias("target_page_title"), "at"), "games": games, "events": events}


def commit_tasks(commits: Commits, requests: DataFrame, pages: DataFrame, models: DataFrame, at: Column) -> DataFrame:
    """Create tasks and write them, their games and their task_selected events, all of them or nothing; returns the verdicts as ``create_tasks`` has them."""
    created = materialize(create_tasks(requests, pages, models), "created")
    commits.append(**task_tables(requests, created, at))
    return created


def emitted(games: DataFrame, moves: DataFrame) -> DataFrame:
    """game_id, seq, type: a move_completed for each move of a game, then game_ended once it is over."""
    made = moves.join(games.select("game_id"), "game_id").select("game_id", F.col("step").cast("long").alias("seq"), F.lit("move_completed").alias("type"))
    last = games.filter(F.col("status").isin(*FINISHED)).join(made.groupBy("game_id").agg(F.max("seq").alias("n")), "game_id", "left")
    return made.unionByName(last.select("game_id", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("seq"), F.lit("game_ended").alias("type")))


# What players are told, here and in ``link_page``.
def system_prompt(template: Column, start: Column, target: Column) -> Column:
    """The template with its two titles put in; what looks like a place for one in a title stays."""
    parts = F.transform(F.split(template, r"\{start_page_title\}"), lambda part: F.replace(part, F.lit("{target_page_title}"), target))
    return F.aggregate(parts, F.lit(None).cast("string"), lambda done, part: F.when(done.isNull(), part).otherwise(F.concat(done, start, part)))


def shown_text(text: Column) -> Column:
    """A text in quotes: single ones, or double ones where it holds an apostrophe and no double quote; backslashes, and apostrophes within single quotes, are escaped."""
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def turn_prompt(title: Column, links: Column, first: bool = False) -> Column:
    """What a player is told on a page: its title and the links, as a list of quoted texts."""
    shown = F.concat(F.lit("["), F.array_join(F.transform(links, shown_text), ", "), F.lit("]"))
    return F.concat(F.lit("You are currently on the page '" if first else "You are now on the page '"), title, F.lit("'.\nHere are the available links:\n"), shown)


def is_link(links: Column, title: Column) -> Column:
    """Whether a title is among a page's links; no links: false."""
    return F.coalesce(F.array_contains(links, title), F.lit(False))


def missing_arguments(required: Sequence[str], given: Column) -> Column:
    """The required names that a map of arguments lacks, in their order."""
    return F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.array_contains(F.map_keys(given), r))


def merged_settings(defaults: Column, overrides: Column) -> Column:
    """Default settings, each replaced by the override of its name."""
    kept = F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(overrides), k))
    return F.map_concat(kept, overrides)


def link_page(title: Column, links: Column) -> Column:
    """A page as text: title, number of links, links line by line."""
    some = F.concat(F.lit("Current Page: "), title, F.lit("\nTotal Links: "), F.size(links).cast("string"), F.lit("\n\nAvailable Links:\n"), F.array_join(links, "\n"))
    return F.when(F.size(links) > 0, some).otherwise(F.concat(F.lit("Current Page: "), title, F.lit("\nNo links found on this page.")))


def solver_cache(states: DataFrame) -> DataFrame:
    """game_id, page_title, distance: of results of one game and page the last counts."""
    last = states.groupBy("game_id", "page_title").agg(F.max_by("distance", "move_index").alias("distance"))
    return last.filter("distance IS NOT NULL")


def complete_states(games: DataFrame, cache: DataFrame) -> DataFrame:
    """game_id, status, steps and solver_results, the cached results sorted by page; none: an empty array."""
    results = cache.groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct("page_title", "distance"))).alias("solver_results"))
    none = F.expr("CAST(array() AS array<struct<page_title:string,distance:bigint>>)")
    return games.select("game_id", "status", "steps").join(results, "game_id", "left").withColumn("solver_results", F.coalesce("solver_results", none))


def latest_paths(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """With ``latest``: the last array ``paths`` up to a row of its game that isn't empty; before the first, an empty one."""
    upto = Window.partitionBy("game_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(F.when(F.size("paths") > 0, F.col("paths")), ignorenulls=True).over(upto)
    return rows.withColumn("latest", F.coalesce(found, F.expr("CAST(array() AS array<string>)")))


def task_lengths(results: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """task_id, length: of solver results (task_id, at, length) the first that isn't 0; tasks without one are left out.

    With ``starts`` (task_id, start_page_title) only results from a task's start
    page count, which ``results`` then tell as page_title.
    """
    if starts is not None:
        own = starts.select("task_id", F.col("start_page_title").alias("page_title")).distinct()
        results = results.join(own, ["task_id", "page_title"], "left_semi")
    return results.filter("length > 0").groupBy("task_id").agg(F.min_by("length", "at").alias("length"))


def active_tasks(players: DataFrame) -> DataFrame:
    """task_id and the games (sorted) that still run, for players (task_id, game_id, ended); tasks whose games are all over are pruned."""
    return players.filter(~F.col("ended")).groupBy("task_id").agg(F.sort_array(F.collect_set("game_id")).alias("games"))


def monitoring(players: DataFrame, viewers: DataFrame) -> DataFrame:
    """One row: active games, active tasks, connections of viewers (game_id)."""
    live = players.filter(~F.col("ended")).agg(F.countDistinct("game_id").alias("active_games"), F.countDistinct("task_id").alias("active_tasks"))
    return live.crossJoin(viewers.agg(F.count("game_id").alias("connections")))


def viewers_by_game(viewers: DataFrame) -> DataFrame:
    """game_id, connections: only games that someone watches."""
    return viewers.filter("game_id IS NOT NULL").groupBy("game_id").agg(F.count("*").alias("connections"))


def well_formed(events: DataFrame) -> DataFrame:
    """Events that have a type; nothing else is asked of them."""
    return events.filter(F.col("type").isNotNull())


def durations(rows: DataFrame) -> DataFrame:
    """One row over runs (success, seconds): total, successes, success_rate, and average, least, most and all seconds."""
    s = F.col("seconds")
    return rows.agg(
        F.count("*").alias("total"), F.count_if("success").alias("successes"), (F.count_if("success") / F.count("*")).alias("success_rate"),
        F.avg(s).alias("avg_duration"), F.min(s).alias("min_duration"), F.max(s).alias("max_duration"), F.sum(s).alias("total_duration"),
    )


def rings(nodes: DataFrame) -> DataFrame:
    """task_id, max_distance, rings: the distances from 1 to two beyond the most."""
    most = nodes.filter("distance IS NOT NULL").groupBy("task_id").agg(F.max("distance").alias("max_distance"))
    return most.withColumn("rings", F.sequence(F.lit(1).cast("long"), (F.col("max_distance") + 2).cast("long")))
