"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.llm.common import GAP, broadcast_up_to, documents, lower_az, materialize, text_of, words
from navgraph.llm.quality import let

#: Tables of items' shingles, and of keys of candidates, with more rows than this are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000


def shingles(text: Column, width: int) -> Column:
    """The distinct ``width``-word shingles of a text; the whole sequence where it has fewer words; none without words."""
    part = lambda w, i: F.array_join(F.slice(w, i + 1, width), " ")
    many = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda i: part(w, i))
    return F.array_distinct(let(words(lower_az(text)), lambda w: F.when(F.size(w) > 0, many(w)).otherwise(F.expr("CAST(array() AS array<string>)"))))


def find(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents that hold at least ``percent`` of an item's distinct shingles.

    ``docs`` has doc_id and text, ``items`` item_id and text. The result has one
    row for each document and item found: key (of the document's id and text),
    doc_id, item_id, n_shingles (the item's), n_shared.

    One hash function orders all shingles. Items are partitioned by set size,
    and the bottom-k sketch of an item of n shingles has k = n - need + 1
    values, where need is the number that must be shared. A document that
    shares ``need`` of them lacks k - 1 at most, so it holds one of the
    sketch's values: no document is missed, however long. A document meets only
    items of partitions whose need its own size reaches. What the sketches find
    is verified by counting equal shingles as strings.

    An item of fewer than ``width`` words is one shingle of its own width, and
    documents are then cut in shingles of that width as well: it is found in
    whatever document has its words in a row. OP4_SQL finds such an item only
    in documents that are nothing else.

    Null and empty texts have no shingles, are never found and find nothing.
    Equal rows give one result; items with one id and unlike texts are separate.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of()))
    tests = items.select("item_id", text_of().alias("t")).distinct()
    tests = tests.select("item_id", F.md5("t").alias("item_key"), F.least(F.size(words(lower_az(F.col("t")))), F.lit(width)).alias("width"), shingles(F.col("t"), width).alias("set")).filter(F.size("set") > 0)
    tests = tests.withColumn("n_shingles", F.size("set").cast("long")).withColumn("need", F.expr(f"({percent} * n_shingles + 99) div 100"))
    tests = materialize(tests.withColumn("size_class", F.floor(F.log2("n_shingles"))), "test-items")

    hashed = F.sort_array(F.transform("set", lambda s: F.xxhash64(s)))
    sketch = F.slice(hashed, 1, (F.col("n_shingles") - F.col("need") + 1).cast("int"))
    sketches = materialize(tests.select("item_id", "item_key", "need", "width", "size_class", F.explode(sketch).alias("value")), "test-sketches")
    found = sketches.groupBy("width", "size_class").agg(F.min("need").alias("least"), F.max("value").alias("top")).collect()  # one row for each power of two
    classes = [c for c in found if c["width"] == width]
    short = {c["width"]: c["top"] for c in found if c["width"] < width}  # such items have one shingle

    # Of a document's shingles only those count that some class which the document is large enough for can have in a sketch.
    cut = lambda w, n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, n), " ")))
    hashes = lambda n: F.array_distinct(let(words(lower_az(text_of())), lambda w: F.when(F.size(w) > 0, cut(w, n))))
    top = F.lit(-(1 << 63))
    for c in classes:
        top = F.greatest(top, F.when(F.size("values") >= c["least"], F.lit(c["top"])).otherwise(F.lit(-(1 << 63))))
    probes = docs.select(key.alias("key"), hashes(width).alias("values"), *[hashes(n).alias(f"values_{n}") for n in short]).filter(F.size("values") > 0).withColumn("top", top)
    up_to = lambda most: lambda v: v <= F.lit(most)
    low = [F.filter("values", lambda v: v <= F.col("top")), *[F.filter(f"values_{n}", up_to(most)) for n, most in short.items()]]
    probes = probes.select("key", F.size("values").alias("n_doc"), F.explode(F.concat(*low)).alias("value"))
    met = probes.join(broadcast_up_to(sketches, MAX_BROADCAST_ROWS), "value").filter(F.col("n_doc") >= F.col("need"))
    candidates = materialize(met.select("key", "item_key", "item_id").distinct(), "test-candidates")

    keys = candidates.select("key").distinct()
    suspects = docs.select(key.alias("key"), "doc_id", "text").join(broadcast_up_to(keys, MAX_BROADCAST_ROWS), "key", "left_semi")
    held = suspects.select("key", "doc_id", F.explode(F.concat(*[shingles(text_of(), n) for n in (width, *short)])).alias("shingle"))
    wanted = materialize(tests.select("item_id", "item_key", "n_shingles", "need", F.explode("set").alias("shingle")), "test-shingles")
    shared = held.join(broadcast_up_to(wanted, MAX_BROADCAST_ROWS), "shingle")
    same_item = (F.col("item_id").eqNullSafe(F.col("c_id"))) & (F.col("item_key") == F.col("c_item")) & (F.col("key") == F.col("c_key"))
    counted = shared.groupBy("key", "doc_id", "item_id", "item_key", "n_shingles", "need").agg(F.countDistinct("shingle").alias("n_shared"))
    confirmed = counted.filter("n_shared >= need").join(candidates.toDF("c_key", "c_item", "c_id"), same_item, "left_semi")
    return confirmed.select("key", "doc_id", "item_id", "n_shingles", "n_shared")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are."""
    found = materialize(find(docs, items).select("key").distinct(), "leaks")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of()))
    marked = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key"))
    kept = marked.join(broadcast_up_to(found, MAX_BROADCAST_ROWS), "key", "left_anti")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find(documents(spark, sf_dir).select("doc_id", "text"), items)
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


OP4_SQL = rf"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents UNION
  SELECT 'i', item_id, coalesce(text, '') FROM benchmark),
w AS (
  SELECT side, id, text, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}'), lambda x: x <> '') AS w FROM t),
s AS (
  SELECT side, id, md5(text) AS k, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')))) AS shingle
  FROM w WHERE len(w) > 0),
n AS (SELECT id AS item_id, k, count(*) AS n_shingles FROM s WHERE side = 'i' GROUP BY ALL),
m AS (
  SELECT d.id AS doc_id, d.k AS dk, i.id AS item_id, i.k, count(*) AS n_shared
  FROM s d JOIN s i USING (shingle) WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT m.doc_id, m.item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN n ON m.item_id IS NOT DISTINCT FROM n.item_id AND m.k = n.k WHERE n_shared >= (80 * n_shingles + 99) // 100"""
