"""Operator 3: quality rules combined by weak supervision. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navgraph.llm.common import documents, materialize, text_of, words

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_other", "n_distinct", "n_solid")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where lambdas refer to it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(w: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Windows are compared as strings. Only a text with a repeat is sorted: equal
    windows are then neighbours, and each marks its three positions.
    """
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(window(i).alias("g"), i.alias("p")))

    def marked(s: Column) -> Column:
        same = lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"])
        spots = F.flatten(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
        return F.size(F.array_distinct(spots))

    def counted(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g["g"])) == F.size(g), F.lit(0)).otherwise(let(F.sort_array(g), marked))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, counted)).cast("long")


def without(text: Column, pattern: str) -> Column:
    """How many characters of the class ``pattern`` a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``doc`` (a struct of ``keep``) and the counts that the rules look at; no words or no text: all 0."""
    full = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    base = docs.select(F.struct(*keep).alias("doc"), text_of().alias("t"), words(text_of()).alias("w"))
    base = base.withColumn("lines", F.filter(F.split("t", "\n"), full))
    columns = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": without(F.col("t"), r"[#*$%&|<>]"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": let(F.col("w"), repeated_words),
        "n_lines": F.size("lines"),
        "n_upper": without(F.col("t"), "[A-Z]"),
        "n_marks": without(F.col("t"), "[!?]"),
        "n_other": without(F.col("t"), r"[0-9!-/:-@\[-`{-~]"),
        "n_distinct": F.size(F.array_distinct("w")),
        "n_solid": F.size(words(F.regexp_replace("t", r"[!-/:-@\[-`{-~]+", ""))),
    }
    return base.select("doc", *[c.cast("long").alias(k) for k, c in columns.items()])


@dataclass(frozen=True)
class Rule:
    """A rule votes 0 (bad) where ``bad`` holds, 1 (good) where ``good`` holds, else it abstains (-1)."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN n_words > 0 AND {self.bad} THEN 0 WHEN n_words > 0 AND {self.good} THEN 1 ELSE -1 END").alias(self.name)


RULES = (
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols < n_words"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words < 10 * n_words"),
    Rule("lines", "n_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines", "n_lines >= 3 AND n_dup_lines = 0"),
    Rule("capitals", "100 * n_upper > 30 * word_chars", "100 * n_upper < 10 * word_chars"),
    Rule("exclaims", "100 * n_marks > 20 * n_words", "100 * n_marks < 5 * n_words"),
    Rule("marks", "100 * n_other > 25 * word_chars", "100 * n_other < 12 * word_chars"),
    Rule("lone_marks", "100 * (n_words - n_solid) > 10 * n_words", "100 * (n_words - n_solid) < 2 * n_words"),
    Rule("word_length", "word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    Rule("variety", "n_words >= 30 AND 100 * n_distinct < 15 * n_words", "n_words >= 30 AND n_words <= 3000 AND 100 * n_distinct > 40 * n_words"),
)


#: What is believed before any document is seen: the part of good ones, how often a vote is right on good and on bad ones; and
#: the weight of these beliefs, as so many votes (documents) and as a part of those that there are.
PRIOR, RIGHT, CAUGHT = 0.85, 0.97, 0.3
PRIOR_COUNT, PRIOR_PART = 10.0, 0.05


@dataclass
class Model:
    """Prior of good, and for each rule how often it votes rightly on good and on bad documents, where it votes."""

    prior: float
    good: list[float]
    bad: list[float]

    def log_odds(self, rules: Sequence[Rule]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, a, b in zip(rules, self.good, self.bad, strict=True):
            vote = F.col(rule.name)
            total = total + F.when(vote == 1, math.log(a / (1 - b))).when(vote == 0, math.log((1 - a) / b)).otherwise(0.0)
        return total

    def posterior(self, rules: Sequence[Rule]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(rules)))


def fit(votes: DataFrame, rules: Sequence[Rule], rounds: int = 60, tolerance: float = 1e-7) -> Model:
    """Accuracies by expectation-maximisation over vote patterns.

    ``votes`` has a column for each rule. Rows are first counted by pattern (3 to
    the number of rules at most), and each round is one aggregate over patterns,
    of which only the parameters reach the driver.

    All parameters are those of the most likely mixture given priors (PRIOR,
    RIGHT, CAUGHT) that weigh PRIOR_PART of the data and PRIOR_COUNT votes: they
    move with what the rules say of each other, and are bounded by nothing else.
    The priors tell which of the two classes is the good one. No rows: the priors.
    """
    names = [r.name for r in rules]
    patterns = materialize(votes.groupBy(*names).count(), "vote-patterns")
    model = Model(PRIOR, [RIGHT] * len(rules), [CAUGHT] * len(rules))
    believed = lambda hits, n, mean: (hits + (PRIOR_PART * n + PRIOR_COUNT) * mean) / (n + PRIOR_PART * n + PRIOR_COUNT)
    for _ in range(rounds):
        weighed = patterns.withColumn("p", model.posterior(rules))
        good, bad = F.col("count") * F.col("p"), F.col("count") * (1 - F.col("p"))
        sums = [F.sum(good), F.sum("count")]
        for n in names:
            sums += [F.sum(F.when(F.col(n) == v, y)) for y, v in ((good, 1), (good, 0), (bad, 0), (bad, 1))]
        s = [float(x or 0) for x in weighed.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).first()]
        following = Model(believed(s[0], s[1], PRIOR), [], [])
        for j in range(len(names)):
            right, wrong, caught, missed = s[2 + 4 * j : 6 + 4 * j]
            following.good.append(believed(right, right + wrong, RIGHT))
            following.bad.append(believed(caught, caught + missed, CAUGHT))
        moved = max(abs(x - y) for x, y in zip([model.prior, *model.good, *model.bad], [following.prior, *following.good, *following.bad], strict=True))
        model = following
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, keep: Sequence[str], rules: Sequence[Rule] = RULES, threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Each document's features, votes, posterior probability of quality and verdict.

    ``docs`` has text. The result has ``doc`` (a struct of ``keep``), FEATURES, a
    column for each rule, quality, base_failed and kept. A document goes if it
    has under ``min_words`` words or over ``max_repeat_percent`` of them lie in
    repeated 3-word windows (base_failed), or if its posterior is under
    ``threshold``. Accuracies are learnt from the documents that the posterior
    has a say on, those that don't fail by the base: how a rule votes on short
    junk tells nothing of how it votes among the others. Null and empty texts have no words, so they go. Rows are
    judged one by one: rows that repeat get equal verdicts.
    """
    judged = materialize(features(docs, keep).select("doc", *FEATURES, *[r.vote() for r in rules]), "quality")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    model = fit(judged.filter(~failed), rules)
    out = judged.withColumns({"quality": model.posterior(rules), "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
