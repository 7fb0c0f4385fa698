"""Reading dump files: SQL inserts, tab-separated staging files and lines of JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navgraph.sources.tables import list_files


def in_order(lines: DataFrame) -> DataFrame:
    """Lines of files with ``_order``, by which a later line of a file is greater, and all of a file greater than those of files before it by name.

    A split knows its place in its file, and its lines are read one after the
    other, so nothing is sorted for it.
    """
    m = lines.metadataColumn("_metadata")
    return lines.select("*", F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("at"), F.monotonically_increasing_id().alias("line")).alias("_order"))


@dataclass(frozen=True)
class DumpTable:
    """A table of an SQL dump: the name in INSERT lines, the pattern of a record and the columns of its groups."""

    name: str
    record: str
    columns: tuple[tuple[str, str], ...]


# What records of the dump tables look like.
QUOTED = r"'((?:[^'\\]|\\.)*)'"
PAGE = DumpTable("page", rf"^(\d+),(\d+),{QUOTED},([01]),", (("page_id", "bigint"), ("namespace", "int"), ("title", "string"), ("is_redirect", "int")))
PAGELINKS = DumpTable("pagelinks", r"^(\d+),(\d+),(\d+)\)?$", (("pl_from", "bigint"), ("pl_ns", "int"), ("pl_target_id", "bigint")))
REDIRECT = DumpTable("redirect", rf"^(\d+),(\d+),{QUOTED}", (("source_id", "bigint"), ("namespace", "int"), ("target_title", "string")))
LINKTARGET = DumpTable("linktarget", rf"^(\d+),(\d+),{QUOTED}", (("lt_id", "bigint"), ("namespace", "int"), ("title", "string")))
DUMP_TABLES = {t.name: t for t in (PAGE, PAGELINKS, REDIRECT, LINKTARGET)}

#: A tuple of values, in which a bracket within quotes doesn't count.
TUPLE = r"\(((?:[^'()]|'(?:[^'\\]|\\.)*')*)\)"


def _tuples(lines: DataFrame, table: DumpTable, compat: bool) -> DataFrame:
    head = rf"^INSERT INTO `{table.name}` VALUES (.+);$"
    order = [c for c in lines.columns if c == "_order"]
    payload = lines.select(F.regexp_extract("value", head, 1).alias("p"), *order).filter("p <> ''")
    parts = F.split(F.regexp_replace("p", r"^\(|\)$", ""), r"\),\(") if compat else F.regexp_extract_all("p", F.lit(TUPLE), F.lit(1))
    each = payload.select(F.posexplode(parts).alias("nth", "r"), *order)
    return each.select("r", *[F.struct(F.col(f"{c}.*"), "nth").alias(c) for c in order])


def parse_inserts(lines: DataFrame, table: DumpTable, compat: bool = False) -> DataFrame:
    """The records of INSERT lines (column ``value``); other lines, and tuples that aren't records, are skipped.

    ``compat`` splits a line at every ``),(``, so that a title which contains it
    loses its record, as the format's customary reader does; else tuples are
    taken apart with regard to quotes.
    """
    found = _tuples(lines, table, compat).filter(F.col("r").rlike(table.record))
    return found.select(*[F.regexp_extract("r", table.record, k).cast(kind).alias(c) for k, (c, kind) in enumerate(table.columns, 1)], *[c for c in found.columns if c == "_order"])


def read_dump(spark: SparkSession, path: str, name: str, compat: bool = False, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """The records of dump files (compressed or not) and the tuples and lines that aren't any, but for blank lines and those that begin with ``--``.

    Spark deals the byte ranges of uncompressed files to tasks and stitches the
    lines that are cut; dumps have lines of about a megabyte, so a line is the
    unit of work and no tuple is ever cut. ``ordered`` adds ``_order``, the
    place of each record in its file.
    """
    table, lines = DUMP_TABLES[name], spark.read.text(path)
    lines = in_order(lines) if ordered else lines
    head = rf"^INSERT INTO `{table.name}` VALUES (.+);$"
    strange = lines.filter(~F.col("value").rlike(head) & ~F.col("value").rlike(r"^(\s*|--.*)$"))
    tuples = _tuples(lines, table, compat).filter(~F.col("r").rlike(table.record)).select(F.col("r").alias("value"))
    return parse_inserts(lines, table, compat), strange.select("value").unionByName(tuples)


def quoted(column: str) -> Column:
    """A text as it stands in a dump: in quotes, with backslashes before quotes and backslashes."""
    return F.concat(F.lit("'"), F.replace(F.replace(F.col(column), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def write_dump(values: DataFrame, table: DumpTable, path: str, tuples_a_line: int = 1000) -> None:
    """Write rows (columns as they stand in the dump, in their order) as INSERT lines of at most so many tuples."""
    names = [f"c{k}" for k in range(len(values.columns))]
    record = F.concat(F.lit("("), F.concat_ws(",", *names), F.lit(")"))
    # The lower bits of the id number the rows of a task.
    line = F.expr(f"pmod(id, 8589934592) div {tuples_a_line}")
    rows = values.toDF(*names).select(record.alias("r"), F.monotonically_increasing_id().alias("id")).select("r", F.shiftright("id", 33).alias("task"), line.alias("line"))
    lines = rows.groupBy("task", "line").agg(F.array_join(F.collect_list("r"), ",").alias("v"))
    lines.select(F.concat(F.lit(f"INSERT INTO `{table.name}` VALUES "), "v", F.lit(";")).alias("value")).write.text(path)


def _fields(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, Column, list[Column]]:
    """Lines, whether one has all fields and fit ones, and its typed fields."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).select("value", parts.alias("p"))
    typed = [F.get("p", k).try_cast(f.dataType).alias(f.name) for k, f in enumerate(schema)]
    fit = F.size("p") >= len(schema)
    for k, f in enumerate(schema):
        if not isinstance(f.dataType, T.StringType):
            fit &= F.get("p", k).try_cast(f.dataType).isNotNull()
    return lines, F.coalesce(fit, F.lit(False)), typed


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Typed rows of tab-separated files without header, and the lines that have too few or unfit fields; further fields are ignored."""
    lines, fit, typed = _fields(spark, path, schema)
    return lines.filter(fit).select(*typed), lines.filter(~fit).select("value")


def read_tsv_all(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``read_tsv``, in one table: lines that don't fit are rows of nulls."""
    lines, fit, typed = _fields(spark, path, schema)
    return lines.select(*[F.when(fit, c).alias(f.name) for c, f in zip(typed, schema, strict=True)])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=False, quote="", emptyValue="", compression="gzip")


#: A stored game.
GAME = """game_id string, model_id string, config struct<start_page_title:string,target_page_title:string,max_steps:int>, status string, steps int,
  moves array<struct<step:int,from_page_title:string,to_page_title:string,error:struct<type:string,message:string>>>,
  start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, error_message string,
  total_input_tokens bigint, total_output_tokens bigint, total_tokens bigint, total_estimated_cost_usd double, total_api_time_ms double, average_response_time_ms double, api_call_count bigint"""


def read_games(spark: SparkSession, path: str, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored games of JSON lines, and the lines that are no valid game (no JSON, or without id, model, config or status); ``ordered`` adds ``_order``, their place in their file."""
    lines = spark.read.text(path)
    lines = (in_order(lines) if ordered else lines).filter("trim(value) <> ''")
    parsed = lines.select("*", F.from_json("value", f"{GAME}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("g"))
    valid = F.col("g._corrupt").isNull() & F.col("g.game_id").isNotNull() & F.col("g.model_id").isNotNull() & F.col("g.config.start_page_title").isNotNull() & F.col("g.config.target_page_title").isNotNull() & F.col("g.status").isNotNull()
    return parsed.filter(valid).select("g.*", *[c for c in parsed.columns if c == "_order"]).drop("_corrupt"), parsed.filter(~valid).select("value")


def append_games(games: DataFrame, path: str) -> None:
    """Append games as lines of JSON."""
    games.write.mode("append").json(path)


def write_summary(games: DataFrame, path: str) -> None:
    """A line of CSV under a header for each stored game: ids, times, result, task, path and what calls took."""
    reached = F.filter("moves", lambda m: m["to_page_title"].isNotNull())
    path_taken = F.array_join(F.concat(F.array("config.start_page_title"), F.coalesce(F.transform(reached, lambda m: m["to_page_title"]), F.array().cast("array<string>"))), " -> ")
    errors = F.array_join(F.array_distinct(F.filter(F.transform("moves", lambda m: m["error"]["type"]), lambda e: e.isNotNull())), ",")
    calls = ["total_input_tokens", "total_output_tokens", "total_tokens", "total_estimated_cost_usd", "total_api_time_ms", "average_response_time_ms", "api_call_count"]
    rows = games.select(
        "game_id", "start_timestamp", "end_timestamp", "status", "steps", "model_id", F.col("config.start_page_title").alias("start_page"), F.col("config.target_page_title").alias("target_page"),
        F.col("config.max_steps").alias("max_steps"), F.coalesce(F.size(reached), F.lit(0)).alias("successful_moves"), (F.col("status") == "won").alias("target_reached"), F.coalesce("error_message", F.lit("")).alias("error_message"),
        errors.alias("error_types"), path_taken.alias("path_taken"), *calls,
    )
    rows.write.mode("append").option("header", True).csv(path)


#: A model that needs no provider: it chooses links by chance and costs nothing.
RANDOM_MODEL = ("local/random", "Random", 0, 0.0, 0.0)


def read_catalogue(spark: SparkSession, *paths: str, chance: bool = False) -> DataFrame:
    """Models of a JSON catalogue ({"data": [..]}): id, name, created and prices for a token; of rows with one id the last counts.

    Of several paths the first that exists is read; none: no models. ``chance``
    adds the random player, unless the catalogue has its id.
    """
    schema = "data array<struct<id:string,name:string,created:bigint,pricing:struct<prompt:string,completion:string,request:string,input_cache_read:string,input_cache_write:string>>>"
    there = next((p for p in paths if list_files(spark, p)), None)
    rows = (spark.read.schema(schema).json(there, multiLine=True) if there else spark.createDataFrame([], schema)).select(F.posexplode("data").alias("at", "m"))
    price = lambda name: F.col(f"m.pricing.{name}").try_cast("double").alias(f"{name}_price")
    flat = rows.select("at", "m.id", "m.name", "m.created", *[price(n) for n in ("prompt", "completion", "request", "input_cache_read", "input_cache_write")])
    if chance:
        own = spark.createDataFrame([(-1, *RANDOM_MODEL)], "at int, id string, name string, created bigint, prompt_price double, completion_price double")
        flat = flat.unionByName(own, allowMissingColumns=True)
    last = flat.groupBy("id").agg(F.max("at").alias("at"))
    return flat.join(last, ["id", "at"]).drop("at")
