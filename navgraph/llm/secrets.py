"""Operator 8: secrets by patterns and by sliding-window entropy. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.llm.common import documents, text_of
from navgraph.llm.quality import let


@dataclass(frozen=True)
class Kind:
    """A pattern of secrets; matches whose ``group`` has under ``least`` characters are dropped."""

    name: str
    pattern: str
    group: int
    least: int


KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # A match of these two is as long as it can be, so asking for the least length drops the same ones.
    Kind("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", "[0-9a-f]{32,}", 0, 32),
)
#: What a text must have for a kind to be searched in it: the pattern itself, with the least length where that is the same.
HINTS = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}

#: Matches whose lengths are summed together when they are placed.
BLOCK = 256

#: Entropy: candidate strings, the window in characters, and for each character class the bits from which a window is a secret.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
CLASSES = (("^[0-9A-Fa-f-]+$", 3.05), ("^[A-Za-z/_=-]+$", 4.25), ("^[0-9+/_=-]+$", 9.0), ("", 3.75))
#: Candidates that look like these are left to PARTS: this list is also met inside a secret, by its padding, dashes or letters.
ALLOWED = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|example|sample|placeholder|dummy|xxxx|0000|12345678|abcdefgh|(^|/)[a-z]+/[a-z]+/|--|__|=="

#: The classes of the parts of a candidate, below what nearly all random strings of their alphabets reach.
PARTS = (("^[0-9+/_=-]+$", 2.45), ("^[0-9A-Fa-f-]+$", 3.05), ("^[A-Za-z+/_=-]+$", 3.15), ("", 3.3))
#: Parts that are not secrets as a whole: identifiers, placeholders, alphabets, numbers that begin with a date.
PLAIN = (
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^(?:[a-z]+[-_]){0,4}(?:example|sample|placeholder|dummy|abcdefgh|0?12345678)|(?:example|placeholder)(?:[-_]?key)?$"
    r"|^(?:19|20)[0-9]{2}([-_/]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12][0-9]|3[01])[0-9+/_=-]*$"
)
#: Names, paths and compounds, as the form of their words and numbers, and what letters of a word do not do (clusters count as one).
_WORD = "(?:(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*+[A-Z]{0,3}|[A-Z]+)[0-9]{0,4}|[0-9]{1,4})"
WORDS = f"^[+/_=-]*{_WORD}(?:[+/_=-]+{_WORD})*+[+/_=-]*$"
_CLUSTER = "(?>sch|[cpst]h|ck|ng|pf|[b-df-hj-np-tv-xz]){5}"
UNLIKE_WORDS = f"(?i){_CLUSTER}(?=[a-z])|(?<=[a-z]){_CLUSTER}|q[b-df-hj-tv-z]|j[b-df-hj-np-tv-xz]|v[b-df-hjkm-qs-tv-xz]"


def spans(text: Column, kind: Kind) -> Column:
    """Start and end (code points, end exclusive) of a pattern's matches, with the text of the tested group.

    ``split`` gives the texts between the same leftmost non-overlapping matches
    that ``regexp_extract_all`` gives, so running lengths are the positions.
    """

    def placed(m: Column) -> Column:
        # Lengths of a gap and the match after it are summed by blocks, then within the match's block: near linear in the matches.
        index = F.when(F.size(m["full"]) > 0, F.sequence(F.lit(0), F.size(m["full"]) - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
        lengths = F.transform(index, lambda i: F.length(F.get(m["gaps"], i)) + F.length(F.get(m["full"], i)))
        total = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x)
        block = lambda values, k: F.slice(values, k * BLOCK + 1, BLOCK)

        def based(values: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor(F.size(values) / BLOCK).cast("int"))
            before = F.aggregate(blocks, F.array(F.lit(0)), lambda sums, k: F.concat(sums, F.array(F.element_at(sums, -1) + total(block(values, k)))))
            return F.struct(values.alias("lengths"), before.alias("before"))

        def positions(b: Column) -> Column:
            def span(i: Column) -> Column:
                k = F.floor(i / BLOCK).cast("int")
                end = F.get(b["before"], k) + total(F.slice(b["lengths"], k * BLOCK + 1, i - k * BLOCK + 1))
                return F.struct((end - F.length(F.get(m["full"], i))).alias("start"), end.alias("end"), F.get(m["tested"], i).alias("string"))

            return F.transform(index, span)

        return let(let(lengths, based), positions)

    pattern = F.lit(kind.pattern)
    parts = F.struct(
        F.split(text, kind.pattern).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("full"),
        F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("tested"),
    )
    return F.filter(let(parts, placed), lambda s: F.length(s["string"]) >= kind.least)


def peak_entropy(string: Column) -> Column:
    """The most bits of Shannon entropy that a window of WINDOW characters has in an ASCII string.

    A window's entropy is log2(W) - sum(n * log2(n)) / W over its characters'
    counts n. From window to window one character enters and one leaves, so two
    counts and the sum change.
    """
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)])
    put = lambda counts, c, v: F.concat(F.slice(counts, 1, c), F.array(v), F.slice(counts, c + 2, 128))

    def moved(state: Column, code: Column, by: int) -> Column:
        n = F.get(state["counts"], code)
        return F.struct(put(state["counts"], code, n + by).alias("counts"), (state["sum"] + F.get(weight, n + by) - F.get(weight, n)).alias("sum"))

    def peak(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            entered = moved(acc["now"], F.get(codes, i), 1)
            now = F.when(i >= WINDOW, let(entered, lambda s: moved(s, F.get(codes, i - WINDOW), -1))).otherwise(entered)
            bits = lambda s: F.when(i >= WINDOW - 1, F.lit(math.log2(WINDOW)) - s["sum"] / WINDOW).otherwise(0.0)
            return let(now, lambda s: F.struct(s.alias("now"), F.greatest(acc["peak"], bits(s)).alias("peak")))

        empty = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), F.struct(empty.alias("now"), F.lit(0.0).alias("peak")), step)["peak"]

    return let(F.transform(F.split(string, ""), F.ascii), peak)


def threshold(string: Column, classes: Sequence[tuple[str, float]] = CLASSES) -> Column:
    out = F.lit(classes[-1][1])
    for pattern, bits in reversed(classes[:-1]):
        out = F.when(string.rlike(pattern), bits).otherwise(out)
    return out


def random_part(string: Column) -> Column:
    """Whether a name's value, a name, or the candidate itself where its value is shorter than a window, is a secret by PARTS.

    Padding and the name before an '=' are thus not tested with the value, and
    what is plain must be so from end to end.
    """
    split = F.split(F.regexp_replace(string, "=+$", ""), "=+")
    parts = F.concat(F.filter(split, lambda p: F.length(p) >= WINDOW), F.when(F.length(F.element_at(split, -1)) < WINDOW, F.array(string)).otherwise(F.expr("CAST(array() AS array<string>)")))
    plain = lambda p: p.rlike(PLAIN) | (p.rlike(WORDS) & ~p.rlike(UNLIKE_WORDS))
    return F.exists(parts, lambda p: F.when(plain(p), False).otherwise(peak_entropy(p) >= threshold(p, PARTS)))


def scan(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The secrets of each document: ``doc`` (a struct of ``keep``), and ``spans``, an array of (start, rank, end, kind, string).

    ``docs`` has text. Kinds are KINDS, in that rank, then ``entropy``: a
    candidate string in which some window reaches its character class's
    threshold, unless it is on the allow-list, or that has a ``random_part``,
    and that overlaps no span of a pattern. OP8_SQL has the first of the two
    rules only: it lacks secrets with padding, a flag's or name's dashes, or of
    letters or digits alone. ``string`` is the text of the pattern's tested group. Null and empty texts
    have no spans; rows are scanned one by one, whole texts, without a shuffle.
    """
    t, spotless = F.col("t"), "CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string,string:string>>)"
    none = F.expr(spotless)
    base = docs.select(F.struct(*keep).alias("doc"), text_of().alias("t"))

    def tagger(rank: int, kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["string"].alias("string"))

    for rank, kind in enumerate(KINDS):
        tagged = F.transform(spans(t, kind), tagger(rank, kind.name))
        base = base.withColumn(kind.name, F.when(t.rlike(HINTS[kind.name]), tagged).otherwise(none))
    base = base.withColumn("base", F.concat(*[F.col(k.name) for k in KINDS]))

    def secret(s: Column) -> Column:
        clear = ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        high = ~s["string"].rlike(ALLOWED) & (peak_entropy(s["string"]) >= threshold(s["string"]))
        return F.when(clear, F.when(high, True).otherwise(random_part(s["string"]))).otherwise(False)

    candidates = spans(t, Kind("entropy", CANDIDATE, 0, WINDOW))
    found = F.transform(F.filter(candidates, secret), tagger(len(KINDS), "entropy"))
    base = base.withColumn("entropy", F.when(t.rlike(CANDIDATE), found).otherwise(none))
    return base.select("doc", F.sort_array(F.concat("base", "entropy")).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc.doc_id", *[of(k.name) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, row, {rank} AS rank, '{kind}' AS kind, start, start + length("full") AS stop, "full" FROM (
    SELECT doc_id, row, "full"[i] AS full, tested[i] AS tested,
           CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform("full"[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, row, gaps, "full", tested, unnest(range(1, len("full") + 1)) AS i FROM (
      SELECT doc_id, row, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS "full", regexp_extract_all(t, '{p}', {group}) AS tested
      FROM d WHERE regexp_matches(t, '{p}'))))
  WHERE length(tested) >= {least}"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_sql_spans(k.name, i, k.pattern, k.group, k.least) for i, k in enumerate(KINDS))}),
candidates AS ({_sql_spans("entropy", len(KINDS), CANDIDATE, 0, WINDOW)}),
peaks AS (
  SELECT *, list_max(list_transform(range(1, length("full") - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr("full", i, {WINDOW}), ''), 'entropy'))) AS bits
  FROM candidates c
  WHERE NOT regexp_matches("full", '{ALLOWED}')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = c.row AND b.start < c.stop AND c.start < b.stop)),
found AS (
  SELECT doc_id, row, rank, kind, start, stop FROM base
  UNION ALL
  SELECT doc_id, row, rank, kind, start, stop FROM peaks
  WHERE bits >= CASE {" ".join(f"WHEN regexp_matches(" + '"full"' + f", '{p}') THEN {b}" for p, b in CLASSES[:-1])} ELSE {CLASSES[-1][1]} END),
g AS (
  SELECT row,
         count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(KINDS)}), '') AS base_spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY row)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)"""
