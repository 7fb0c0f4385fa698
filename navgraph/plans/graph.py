"""Queries on the link graph: building it, looking things up, and shortest paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.functions.titles import decode_ids, encode_ids, fold, readable, sanitize
from navgraph.operators import links as L
from navgraph.operators import paths as P
from navgraph.operators.race import optimal_nodes
from navgraph.operators.store import GraphStore, null_profile
from navgraph.operators.store import seeded_sample as sample
from navgraph.operators.tasks import coverage
from navgraph.plans.registry import query
from navgraph.session import shared_dir
from navgraph.sources import dumps as D
from navgraph.sources import views as V
from navgraph.sources.tables import fingerprint, is_kept, kept

#: Goes up whenever the code that makes the graph's tables comes to make others.
GRAPH_VERSION = 3
#: The graph as common table expressions: redirect_ids, resolved, edges_raw, edges, pruned.
GRAPH = f"""WITH RECURSIVE {V.SQL.strip()},
redirect_ids AS (
  SELECT r.source_id, max(p.page_id) AS target_id FROM v_redirects_raw r JOIN v_pages p ON p.title = r.target_title GROUP BY r.source_id),
walk AS (
  SELECT source_id, target_id AS first, target_id AS cur, 0 AS hops FROM redirect_ids
  UNION ALL
  SELECT w.source_id, w.first, r.target_id, w.hops + 1 FROM walk w JOIN redirect_ids r ON r.source_id = w.cur WHERE r.target_id <> w.first AND w.hops < 100),
resolved AS (SELECT source_id, cur AS target_id FROM walk WHERE cur NOT IN (SELECT source_id FROM redirect_ids)),
edges_raw AS (
  SELECT l.pl_from AS src_id, p.page_id AS dst_id FROM v_links_raw l JOIN v_linktargets t ON t.lt_id = l.pl_target_id
  JOIN v_pages p ON p.namespace = t.namespace AND p.title = t.title),
edges AS MATERIALIZED (
  SELECT DISTINCT src_id, dst_id FROM (
    SELECT coalesce(a.target_id, e.src_id) AS src_id, coalesce(b.target_id, e.dst_id) AS dst_id
    FROM edges_raw e LEFT JOIN resolved a ON a.source_id = e.src_id LEFT JOIN resolved b ON b.source_id = e.dst_id)
  WHERE src_id <> dst_id AND src_id IN (SELECT page_id FROM v_pages)),
pruned AS (SELECT * FROM v_pages WHERE NOT is_redirect OR page_id IN (SELECT source_id FROM resolved))"""


def levels_sql(name: str, starts: str, backward: bool = False, depth: int = 7) -> str:
    """Common table expressions {name}0 .. and {name}: query_id, node, level from ``starts`` (query_id, node), ``depth`` levels."""
    here, there = ("dst_id", "src_id") if backward else ("src_id", "dst_id")
    parts = [f"{name}0 AS MATERIALIZED (SELECT DISTINCT query_id, node, 0 AS level FROM ({starts}))"]
    for k in range(1, depth + 1):
        parts.append(f"""{name}{k} AS MATERIALIZED (
  SELECT query_id, node, level FROM {name}{k - 1} UNION ALL
  SELECT n.query_id, n.node, {k} FROM (SELECT DISTINCT f.query_id, e.{there} AS node FROM {name}{k - 1} f JOIN edges e ON e.{here} = f.node WHERE f.level = {k - 1}) n
  LEFT JOIN {name}{k - 1} o ON o.query_id = n.query_id AND o.node = n.node WHERE o.node IS NULL)""")
    return ",\n".join(parts) + f",\n{name} AS (SELECT * FROM {name}{depth})"


def graph(spark: SparkSession, sf_dir: str) -> GraphStore:
    """The store of a folder's tables: pruned pages, resolved redirects, edges and degrees, each built when first read.

    Each table is kept in the shared folder under a fingerprint of its source
    files (names, sizes, times) and the version of the code that makes it, so
    later queries reuse it while both are the same. Pages are kept by title and
    by id, edges by source and by target, of which the one that is asked for
    first is made of the links and the other of it. Lookups of titles never build
    edges.
    """
    pages = V.pages(spark, sf_dir)
    at = fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in ("part", "lineitem")])
    named = lambda name: f"graph-{GRAPH_VERSION}-{at}-{name}"
    keep = lambda name, build, key=None, filtered=(), distinct=False: kept(spark, named(name), build, key, filtered, f"{name} of {sf_dir}", distinct)
    redirects = keep("resolved", lambda: L.resolve_redirects(L.redirect_ids(V.redirects_raw(spark, sf_dir), pages))).df
    titles = keep("pages", lambda: L.pruned_pages(pages, redirects).withColumn("folded", fold(F.col("title"))), "folded", ["page_id"])
    by_id = lambda: keep("pages-by-id", lambda: titles.df, "page_id", ["folded"])
    links = lambda: V.links_of(parts_kept(spark, sf_dir)) if is_kept(spark, _parts_name(spark, sf_dir)) else V.links_raw(spark, sf_dir)
    linked = lambda: L.linked(links(), V.linktargets(spark, sf_dir), pages, redirects)
    other = lambda name, there: there() if is_kept(spark, named(name)) else None
    edges = lambda: keep("edges", lambda: other("edges-in", incoming) or linked(), "src_id", ["dst_id"], True).df
    incoming = lambda: keep("edges-in", lambda: other("edges", edges) or linked(), "dst_id", ["src_id"], True).df
    degrees = lambda: keep("degrees", lambda: L.degrees(edges()), "page_id").df
    return GraphStore(titles.df, redirects, edges, incoming, degrees, titles, by_id)


def _parts_name(spark: SparkSession, sf_dir: str) -> str:
    return f"parts-{GRAPH_VERSION}-{fingerprint(spark, [f'{sf_dir}/lineitem.parquet'])}"


def parts_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order, kept like the graph's tables: games are walked from them, and links made of them, without dealing the lines again."""
    return kept(spark, _parts_name(spark, sf_dir), lambda: V.orders_parts(spark, sf_dir), of=f"parts of {sf_dir}").df


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve_redirects(L.redirect_ids(V.redirects_raw(spark, sf_dir), V.pages(spark, sf_dir)))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edges_by_id(V.links_raw(spark, sf_dir), V.linktargets(spark, sf_dir), V.pages(spark, sf_dir))


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A few rows as a DataFrame without a Python stage."""
    names = [c.split()[0] for c in schema.split(",")]
    text = ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in values)
    kinds = [c.split()[1] for c in schema.split(",")]
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})").select(*[F.col(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])


@query(GRAPH + " SELECT (SELECT count(*) FROM pruned) AS pages, (SELECT count(*) FROM edges) AS links")
def graph_stats(spark, sf_dir):
    return graph(spark, sf_dir).stats()


@query(GRAPH + " SELECT src_id, dst_id FROM edges_raw")
def edges_ids_only(spark, sf_dir):
    return raw_edges(spark, sf_dir)


@query(GRAPH + """ SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN l.pl_from % 13 = 5 THEN 'malformed' WHEN s.page_id IS NULL THEN 'missing_source' WHEN t.lt_id IS NULL THEN 'unknown_target' WHEN p.page_id IS NULL THEN 'red_link' ELSE 'ok' END AS reason
  FROM v_links_raw l LEFT JOIN v_pages s ON s.page_id = l.pl_from AND s.page_id % 17 <> 3 LEFT JOIN v_linktargets t ON t.lt_id = l.pl_target_id AND t.lt_id % 70 <> 0
  LEFT JOIN v_pages p ON p.namespace = t.namespace AND p.title = t.title AND p.page_id % 11 <> 0 AND p.page_id % 17 <> 3) GROUP BY reason""")
def edge_skip_reasons(spark, sf_dir):
    """Links read from a staging file in which some lines are cut short; parts of the link targets and pages are taken away, so that there is something to skip."""
    pages, targets = V.pages(spark, sf_dir), V.linktargets(spark, sf_dir)
    short = F.col("pl_from") % 13 == 5
    lines = V.links_raw(spark, sf_dir).select("pl_from", "pl_ns", F.when(~short, F.col("pl_target_id")).alias("pl_target_id"))
    path = f"{shared_dir(spark)}/navgraph/links-{uuid.uuid4().hex}"
    D.write_tsv(lines, path)
    links = D.read_tsv_all(spark, path, lines.schema)
    known = pages.filter("page_id % 17 <> 3").withColumn("title", F.when(F.col("page_id") % 11 != 0, F.col("title")))
    return L.skip_reasons(links, targets.filter("lt_id % 70 <> 0"), known)


@query(GRAPH + " SELECT src_id, dst_id FROM edges")
def edges_from_dumps(spark, sf_dir):
    """The graph from dump files: pages, links, redirects and link targets are written as SQL dumps, read in splits, staged as tables of tabs, and joined."""
    base = f"{shared_dir(spark)}/navgraph/dumps-{uuid.uuid4().hex}"
    number, text = (lambda c: F.col(c).cast("string")), D.quoted
    made = {
        "page": V.pages(spark, sf_dir).select(number("page_id"), number("namespace"), text("title"), F.col("is_redirect").cast("int").cast("string"), F.lit("0.5"), F.lit("NULL")),
        "pagelinks": V.links_raw(spark, sf_dir).select(number("pl_from"), number("pl_ns"), number("pl_target_id")),
        "redirect": V.redirects_raw(spark, sf_dir).select(number("source_id"), number("namespace"), text("target_title"), F.lit("''"), F.lit("NULL")),
        "linktarget": V.linktargets(spark, sf_dir).select(number("lt_id"), number("namespace"), text("title")),
    }
    staged = {}
    for name, values in made.items():
        D.write_dump(values, D.DUMP_TABLES[name], f"{base}/{name}.sql")
        found, _ = D.read_dump(spark, f"{base}/{name}.sql", name)
        D.write_tsv(found, f"{base}/{name}.txt")
        staged[name], _ = D.read_tsv(spark, f"{base}/{name}.txt", found.schema)
    pages = staged["page"].withColumn("is_redirect", F.col("is_redirect") == 1)
    redirects = L.resolve_redirects(L.redirect_ids(staged["redirect"], pages))
    return L.resolved_edges(staged["pagelinks"], staged["linktarget"], pages, redirects)


@query(GRAPH + " SELECT source_id, target_id FROM redirect_ids")
def redirect_ids(spark, sf_dir):
    return L.redirect_ids(V.redirects_raw(spark, sf_dir), V.pages(spark, sf_dir))


@query(GRAPH + " SELECT source_id, target_id FROM resolved")
def resolved_redirects(spark, sf_dir):
    return resolved(spark, sf_dir)


@query(GRAPH + " SELECT page_id, namespace, title, is_redirect FROM pruned")
def pruned_pages(spark, sf_dir):
    return L.pruned_pages(V.pages(spark, sf_dir), resolved(spark, sf_dir))


@query(GRAPH + " SELECT src_id, dst_id FROM edges")
def resolved_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges


def _grouped_sql(by: str, other: str) -> str:
    return GRAPH + f" SELECT {by} AS page_id, string_agg(CAST({other} AS VARCHAR), '|' ORDER BY {other}) AS ids FROM edges GROUP BY {by}"


@query(_grouped_sql("src_id", "dst_id"))
def grouped_out(spark, sf_dir):
    return L.grouped(graph(spark, sf_dir).edges, "src_id", "dst_id").select("page_id", encode_ids(F.col("ids")).alias("ids"))


@query(_grouped_sql("dst_id", "src_id"))
def grouped_in(spark, sf_dir):
    return L.grouped(graph(spark, sf_dir).edges, "dst_id", "src_id").select("page_id", encode_ids(F.col("ids")).alias("ids"))


@query(GRAPH + """ SELECT coalesce(o.page_id, i.page_id) AS page_id, coalesce(outgoing, '') AS outgoing, coalesce(incoming, '') AS incoming,
  coalesce(o.n, 0) AS outgoing_count, coalesce(i.n, 0) AS incoming_count
  FROM (SELECT src_id AS page_id, count(*) AS n, string_agg(CAST(dst_id AS VARCHAR), '|' ORDER BY dst_id) AS outgoing FROM edges GROUP BY 1) o
  FULL JOIN (SELECT dst_id AS page_id, count(*) AS n, string_agg(CAST(src_id AS VARCHAR), '|' ORDER BY src_id) AS incoming FROM edges GROUP BY 1) i ON o.page_id = i.page_id""")
def adjacency(spark, sf_dir):
    found = L.adjacency(graph(spark, sf_dir).edges)
    return found.select("page_id", *[encode_ids(F.col(c)).alias(c) for c in ("outgoing", "incoming")], *[F.col(f"{c}_count").cast("long").alias(f"{c}_count") for c in ("outgoing", "incoming")])


_DEGREES = """degrees AS (
  SELECT page_id, CAST(sum(o) AS BIGINT) AS outgoing_count, CAST(sum(i) AS BIGINT) AS incoming_count
  FROM (SELECT src_id AS page_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst_id, 0, 1 FROM edges) GROUP BY page_id)"""


@query(GRAPH + f", {_DEGREES} SELECT page_id, outgoing_count, incoming_count FROM degrees")
def degree_counts(spark, sf_dir):
    return graph(spark, sf_dir).degrees


@query(GRAPH + " SELECT count(*) AS edges, count(DISTINCT (src_id, dst_id)) AS distinct_edges FROM edges_raw")
def distinct_edges(spark, sf_dir):
    return raw_edges(spark, sf_dir).groupBy("src_id", "dst_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("edges"), F.count("*").alias("distinct_edges"))


@query(f"""WITH {V.SQL} SELECT CAST(count(*) FILTER (game_id IS NULL) AS BIGINT) AS game_id, CAST(count(*) FILTER (content IS NULL) AS BIGINT) AS content,
  CAST(count(*) FILTER (input_tokens IS NULL) AS BIGINT) AS input_tokens, CAST(count(*) FILTER (cost IS NULL) AS BIGINT) AS cost FROM v_messages""")
def messages_null_profile(spark, sf_dir):
    return null_profile(V.messages(spark, sf_dir), ["game_id", "content", "input_tokens", "cost"])


_RAW = " SELECT l.pl_from, l.pl_target_id, t.namespace AS target_namespace, t.title AS target_title FROM v_links_raw l JOIN v_linktargets t ON t.lt_id = l.pl_target_id"


def _raw(spark, sf_dir):
    links, t = V.links_raw(spark, sf_dir), V.linktargets(spark, sf_dir)
    return links.join(t, links["pl_target_id"] == t["lt_id"]).select("pl_from", "pl_target_id", F.col("namespace").alias("target_namespace"), F.col("title").alias("target_title"))


@query(GRAPH + _RAW + " WHERE l.pl_from = 17")
def raw_links_for_source(spark, sf_dir):
    return _raw(spark, sf_dir).filter("pl_from = 17").orderBy("target_namespace", "target_title")


@query(GRAPH + _RAW)
def raw_links_all(spark, sf_dir):
    return _raw(spark, sf_dir).orderBy("pl_from", "target_namespace", "target_title")


@query(GRAPH + """ SELECT e.src_id, s.title AS src_title, e.dst_id, t.namespace AS dst_namespace, t.title AS dst_title
  FROM edges e JOIN v_pages s ON s.page_id = e.src_id JOIN v_pages t ON t.page_id = e.dst_id WHERE e.src_id = 17""")
def edges_for_source(spark, sf_dir):
    pages = V.pages(spark, sf_dir)
    e = graph(spark, sf_dir).edges.filter("src_id = 17")
    s = pages.select(F.col("page_id").alias("src_id"), F.col("title").alias("src_title"))
    t = pages.select(F.col("page_id").alias("dst_id"), F.col("namespace").alias("dst_namespace"), F.col("title").alias("dst_title"))
    return e.join(s, "src_id").join(t, "dst_id").select("src_id", "src_title", "dst_id", "dst_namespace", "dst_title").orderBy("src_id", "dst_namespace", "dst_title")


@query(f"""WITH {V.SQL} SELECT page_id, namespace, title, is_redirect AS redirect FROM v_pages""")
def dump_parse(spark, sf_dir):
    """Pages written as lines of an SQL dump and read again, titles with quotes and brackets included."""
    quoted = F.concat(F.lit("'"), F.replace(F.replace(F.concat("title", F.lit("),('x")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    record = F.concat(F.lit("("), F.concat_ws(",", F.col("page_id").cast("string"), F.col("namespace").cast("string"), quoted, F.col("is_redirect").cast("int").cast("string"), F.lit("0.5"), F.lit("NULL")), F.lit(")"))
    lines = V.pages(spark, sf_dir).groupBy(F.floor(F.col("page_id") / 100)).agg(F.array_join(F.collect_list(record), ",").alias("v"))
    text = lines.select(F.concat(F.lit("INSERT INTO `page` VALUES "), "v", F.lit(";")).alias("value")).unionByName(spark.sql("SELECT '-- no record' AS value"))
    found = D.parse_inserts(text, D.PAGE)
    return found.select("page_id", "namespace", F.regexp_replace("title", r"\),\(\\'x$", "").alias("title"), (F.col("is_redirect") == 1).alias("redirect"))


@query(GRAPH + " SELECT page_id, namespace, title FROM pruned WHERE lower(title) = 'item_10'")
def page_by_title(spark, sf_dir):
    return graph(spark, sf_dir).by_title("iTEM 10", -1).select("page_id", "namespace", "title")


@query(GRAPH + " SELECT page_id, replace(title, '_', ' ') AS title FROM pruned WHERE page_id = 21")
def title_by_id(spark, sf_dir):
    return graph(spark, sf_dir).pages_with(rows(spark, [(21,)], "page_id long")).filter("page_id = 21").select("page_id", readable(F.col("title")).alias("title"))


@query(GRAPH + " SELECT page_id FROM pruned WHERE namespace = 0 AND title = 'Item_10'")
def page_id_exact(spark, sf_dir):
    return graph(spark, sf_dir).by_title("Item_10").filter(F.col("title") == "Item_10").select("page_id").limit(1)


_ASKED = ["Item_10", "ITEM 10", "item_10", "item_1", "ITEM_21", "item_16", "ITEM_3", "No such page", "Item_6"]
_BY_TITLE = """
matched AS (
  SELECT a.title AS asked, CASE WHEN NOT p.is_redirect AND p.title = replace(a.title, ' ', '_') THEN 0 WHEN NOT p.is_redirect THEN 1 ELSE 2 END AS rank, p.page_id, r.target_id
  FROM asked a JOIN pruned p ON lower(p.title) = lower(replace(a.title, ' ', '_')) AND p.namespace = 0 LEFT JOIN resolved r ON r.source_id = p.page_id),
best AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY rank, page_id) AS n FROM matched),
ids AS (SELECT a.title, CASE WHEN b.rank < 2 THEN b.page_id ELSE b.target_id END AS page_id FROM asked a LEFT JOIN best b ON b.asked = a.title AND b.n = 1)"""
_RESOLVE = GRAPH + f", asked AS (SELECT unnest({_ASKED}) AS title)," + _BY_TITLE + " SELECT title, page_id FROM ids"


@query(_RESOLVE)
def resolve_title(spark, sf_dir):
    return graph(spark, sf_dir).resolve(rows(spark, [(t,) for t in _ASKED], "title string"))


@query(_RESOLVE)
def batch_ids(spark, sf_dir):
    return graph(spark, sf_dir).resolve(spark.sql("SELECT explode(split('" + "#".join(_ASKED) + "', '#')) AS title"))


_IDS = [5, 17, 999_999_999, 5, 94]


@query(GRAPH + f""", asked AS (SELECT unnest({_IDS}) AS page_id, unnest(range({len(_IDS)})) AS pos)
SELECT pos, a.page_id, replace(p.title, '_', ' ') AS title FROM asked a LEFT JOIN pruned p ON p.page_id = a.page_id""")
def batch_titles(spark, sf_dir):
    asked = rows(spark, list(enumerate(_IDS)), "pos long,page_id long")
    return graph(spark, sf_dir).titles(asked).select("pos", "page_id", "title").orderBy("pos")


def _links_sql(here: str, there: str) -> str:
    return GRAPH + f""", asked AS (SELECT DISTINCT unnest({_IDS}) AS page_id) SELECT a.page_id, coalesce(string_agg(CAST({there} AS VARCHAR), '|' ORDER BY {there}), '') AS links
  FROM asked a LEFT JOIN edges e ON e.{here} = a.page_id GROUP BY a.page_id"""


def _links(spark, sf_dir, incoming):
    asked = rows(spark, [(i,) for i in sorted(set(_IDS))], "page_id long")
    return graph(spark, sf_dir).neighbours(asked, incoming).select("page_id", encode_ids(F.col("links")).alias("links"))


@query(_links_sql("src_id", "dst_id"))
def outgoing_links(spark, sf_dir):
    return _links(spark, sf_dir, False)


@query(_links_sql("dst_id", "src_id"))
def incoming_links(spark, sf_dir):
    return _links(spark, sf_dir, True)


@query(GRAPH + f""" SELECT (SELECT count(*) FROM edges WHERE src_id IN ({", ".join(map(str, _IDS))})) AS outgoing,
  (SELECT count(*) FROM edges WHERE dst_id IN ({", ".join(map(str, _IDS))})) AS incoming""")
def frontier_link_sum(spark, sf_dir):
    store, asked = graph(spark, sf_dir), rows(spark, [(i,) for i in _IDS], "page_id long")
    return store.link_sum(asked).withColumnRenamed("total_links", "outgoing").crossJoin(store.link_sum(asked, True).withColumnRenamed("total_links", "incoming"))


@query(GRAPH + f" SELECT page_id FROM pruned WHERE page_id IN ({', '.join(map(str, _IDS))})")
def pages_exist(spark, sf_dir):
    return graph(spark, sf_dir).exists(rows(spark, [(i,) for i in sorted(set(_IDS))], "page_id long"))


@query(f"WITH {V.SQL} SELECT page_id, title FROM (SELECT page_id, title, row_number() OVER (ORDER BY md5('42|' || page_id), page_id) AS n FROM v_pages) WHERE n <= 100")
def seeded_sample(spark, sf_dir):
    return sample(V.pages(spark, sf_dir), 100, 42).select("page_id", "title")


_ODD = ["Notre Dame Fighting Irish", "Farmers' market", 'The "quoted" page', "Complex/Title\\With|Special*Characters", "  multiple   spaces ", "under_score"]
_Q = {c: "'" + c.replace("'", "''") + "'" for c in ("'", "\\'", '"', '\\"', "\\", "\\\\", " ", "_")}


def _nested(expr: str, steps: list[tuple[str, str]]) -> str:
    for a, b in steps:
        expr = f"replace({expr}, {_Q[a]}, {_Q[b]})"
    return expr


@query(f"WITH {V.SQL}, odd AS (SELECT unnest([" + ", ".join("'" + t.replace("'", "''") + "'" for t in _ODD) + f"]) AS o, unnest(range({len(_ODD)})) AS k), "
       f"t AS (SELECT page_id, o || title AS title FROM v_pages JOIN odd ON page_id % {len(_ODD)} = k), "
       "s AS (SELECT *, " + _nested("trim(title)", [("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'), (" ", "_")]) + " AS stored FROM t) "
       "SELECT page_id, title, stored, " + _nested("stored", [("_", " "), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\")]) + " AS shown FROM s")  # fmt: skip
def title_roundtrip(spark, sf_dir):
    """Titles of pages behind odd beginnings, stored and shown again."""
    begins = F.element_at(F.array(*map(F.lit, _ODD)), (F.col("page_id") % len(_ODD) + 1).cast("int"))
    titles = V.pages(spark, sf_dir).select("page_id", F.concat(begins, "title").alias("title"))
    return titles.withColumn("stored", sanitize(F.col("title"))).withColumn("shown", readable(F.col("stored")))


@query(GRAPH + " SELECT pl_from AS page_id, string_agg(CAST(pl_target_id AS VARCHAR), '|' ORDER BY pl_target_id) AS ids, count(*) AS n FROM v_links_raw GROUP BY pl_from UNION ALL SELECT -1, '', 0")
def id_text_roundtrip(spark, sf_dir):
    """The raw links of each page as text, decoded and encoded again, and a page without any."""
    lists = V.links_raw(spark, sf_dir).groupBy(F.col("pl_from").alias("page_id")).agg(encode_ids(F.sort_array(F.collect_list("pl_target_id"))).alias("text"))
    texts = lists.unionByName(rows(spark, [(-1, "")], "page_id long,text string")).withColumn("a", decode_ids(F.col("text")))
    return texts.select("page_id", encode_ids(F.col("a")).alias("ids"), F.size("a").cast("long").alias("n"))


@query(GRAPH + ",\n" + levels_sql("f", "SELECT 1 AS query_id, 1 AS node") + " SELECT query_id, node, level FROM f")
def bfs_levels(spark, sf_dir):
    return P.levels(graph(spark, sf_dir).edges, rows(spark, [(1, 1)], "query_id long,node long"))


_PAIRS = [(1, 1, 2), (2, 1, 77), (3, 5, 120), (4, 9, 9), (5, 30, 101), (6, 1, 999_999)]
_PAIRS_SQL = "pairs AS (SELECT * FROM (VALUES " + ", ".join(map(str, _PAIRS)) + ") AS p(query_id, src_id, dst_id))"
_REACHED = GRAPH + f",\n{_PAIRS_SQL},\n" + levels_sql("f", "SELECT query_id, src_id AS node FROM pairs")


def _pairs(spark):
    return rows(spark, _PAIRS, "query_id long,src_id long,dst_id long")


@query(_REACHED + " SELECT p.query_id, f.level AS length FROM pairs p JOIN f ON f.query_id = p.query_id AND f.node = p.dst_id")
def shortest_path_length(spark, sf_dir):
    return P.path_lengths(graph(spark, sf_dir).edges, _pairs(spark))


@query(_REACHED + " SELECT p.query_id, f.level AS length, true AS connected, CAST(1 AS BIGINT) AS paths FROM pairs p JOIN f ON f.query_id = p.query_id AND f.node = p.dst_id")
def single_shortest_paths(spark, sf_dir):
    """One path a pair, with whether it is a path, and how many there are."""
    edges = graph(spark, sf_dir).edges
    found = P.connected(P.single_paths(edges, _pairs(spark)), edges)
    ends = _pairs(spark).join(found, "query_id")
    whole = F.col("connected") & (F.element_at("path", 1) == F.col("src_id")) & (F.element_at("path", -1) == F.col("dst_id"))
    return ends.groupBy("query_id").agg(F.max("length").alias("length"), F.bool_and(whole).alias("connected"), F.count("*").alias("paths"))


_BACK = """,
trail AS (
  SELECT p.query_id, f.node, f.level, f.level AS length, CAST(f.node AS VARCHAR) AS path FROM pairs p JOIN f ON f.query_id = p.query_id AND f.node = p.dst_id
  UNION ALL
  SELECT t.query_id, e.src_id, t.level - 1, t.length, CAST(e.src_id AS VARCHAR) || '|' || t.path
  FROM trail t JOIN edges e ON e.dst_id = t.node JOIN f ON f.query_id = t.query_id AND f.node = e.src_id AND f.level = t.level - 1)"""


@query(_REACHED + _BACK + " SELECT query_id, length, path FROM trail WHERE level = 0")
def shortest_paths(spark, sf_dir):
    found = P.shortest_paths(graph(spark, sf_dir).edges, _pairs(spark))
    return found.select("query_id", "length", encode_ids(F.col("path")).alias("path"))


@query(_REACHED + _BACK + ", hop AS (SELECT query_id, length, path, unnest(string_split(path, '|')) AS node FROM trail WHERE level = 0) SELECT query_id, CAST(node AS BIGINT) AS page, min(length - list_position(string_split(path, '|'), node) + 1) AS distance FROM hop GROUP BY 1, 2")
def optimal_path_nodes(spark, sf_dir):
    return optimal_nodes(P.shortest_paths(graph(spark, sf_dir).edges, _pairs(spark)))


_TASKS = [(1, "Item_3", "Item_40"), (2, "item 10", "Item_99"), (3, "Nowhere", "Item_1"), (4, "Item_1", "Nowhere"), (5, "Item_8", "Item_8")]


_SOLVED = GRAPH + ", tasks AS (SELECT * FROM (VALUES " + ", ".join(map(str, _TASKS)) + """) AS t(query_id, start, target)),
asked AS (SELECT start AS title FROM tasks UNION SELECT target FROM tasks),""" + _BY_TITLE + """,
pairs AS (SELECT t.query_id, s.page_id AS src_id, g.page_id AS dst_id FROM tasks t JOIN ids s ON s.title = t.start JOIN ids g ON g.title = t.target),
""" + levels_sql("f", "SELECT query_id, src_id AS node FROM pairs WHERE src_id IS NOT NULL AND dst_id IS NOT NULL") + """,
trail AS (
  SELECT p.query_id, f.node, f.level, f.level AS length, g.title AS path FROM pairs p JOIN f ON f.query_id = p.query_id AND f.node = p.dst_id JOIN pruned g ON g.page_id = f.node
  UNION ALL
  SELECT t.query_id, e.src_id, t.level - 1, t.length, g.title || ' -> ' || t.path
  FROM trail t JOIN edges e ON e.dst_id = t.node JOIN f ON f.query_id = t.query_id AND f.node = e.src_id AND f.level = t.level - 1 JOIN pruned g ON g.page_id = e.src_id)
SELECT p.query_id, CASE WHEN p.src_id IS NULL THEN 'start_not_found' WHEN p.dst_id IS NULL THEN 'target_not_found' WHEN w.length IS NULL THEN 'no_path' ELSE 'ok' END AS status, w.length, w.path
FROM pairs p LEFT JOIN (SELECT * FROM trail WHERE level = 0) w ON w.query_id = p.query_id"""


@query(_SOLVED)
def solved_tasks(spark, sf_dir):
    """Titles to all shortest paths as titles, with a status for each task."""
    store = graph(spark, sf_dir)
    found = P.solve(store.edges, store.pages, rows(spark, _TASKS, "query_id long,start string,target string"), store.resolve)
    return found.select("query_id", "status", "length", F.array_join("titles", " -> ").alias("path"))


@query(GRAPH + " SELECT count(DISTINCT src_id) AS with_outgoing, count(DISTINCT dst_id) AS with_incoming, count(*) AS links FROM edges")
def coverage_stats(spark, sf_dir):
    return coverage(graph(spark, sf_dir).edges)


@query(f"WITH {V.SQL} SELECT lower(title) AS folded, count(*) AS n FROM v_pages GROUP BY 1")
def folded_titles(spark, sf_dir):
    return V.pages(spark, sf_dir).groupBy(fold(F.col("title")).alias("folded")).agg(F.count("*").alias("n"))
