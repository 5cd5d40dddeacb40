"""Quality filtering by a learned decision list.

``text_statistics`` measures every whole text with SQL expressions. ``learn_rules``
runs sequential covering on labelled statistics: a rule for bad documents grows by
the threshold test with the best information gain, is pruned on held-out rows, and
is kept if it is precise there; the rows it covers leave, and the next rule grows.
The result is an ordered list of threshold conjunctions, emitted as one
``CASE WHEN`` expression.

Only the learning is bounded: it sees at most ``max_labelled`` labelled rows, those
whose identifiers have the smallest hashes. Every document is measured and judged.

Defined results: null or empty text has no words and fails the base rules. Rows with
a null identifier or label take no part in learning. Without labels the list is empty
and only the base rules decide. Repeated rows are judged alike; an empty table gives
no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table, words_of

#: Bound of the labelled sample that the learner sees.
MAX_LABELLED = 8000
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
SYMBOLS = "[#*$%&|<>]"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "upper_rate", "mark_rate", "digit_rate")


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that occurs twice or more in ``words``.

    Windows are hashed and sorted as plain longs; only if two hashes meet are they
    sorted again with their places, and neighbours compared word by word."""
    n = F.size(words)
    places = F.sequence(F.lit(1), n - 2)
    code = lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))
    codes = F.transform(places, code)
    placed = F.sort_array(F.transform(places, lambda i: F.struct(code(i).alias("c"), i.alias("i"))))
    same = lambda a, b: (a["c"] == b["c"]) & (F.slice(words, a["i"], 3) == F.slice(words, b["i"], 3))
    repeated = lambda s: F.sort_array(
        F.transform(
            F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.size(s)),
                    lambda k: F.struct(
                        s[k - 1]["i"].alias("i"),
                        (F.when(k > 1, same(s[F.greatest(k - 2, F.lit(0))], s[k - 1])).otherwise(False) | F.when(k < F.size(s), same(s[k - 1], s[F.least(k, F.size(s) - 1)])).otherwise(False)).alias("twice"),
                    ),
                ),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        )
    )
    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.when(acc["last"] == 0, 3).otherwise(F.least(F.lit(3), i - acc["last"]))).alias("n")),
        lambda acc: acc["n"],
    )
    counted = F.element_at(F.transform(F.array(placed), lambda s: covered(repeated(s))), 1)
    return F.when(n < 4, F.lit(0).cast("long")).when(F.size(F.array_distinct(codes)) == n - 2, F.lit(0).cast("long")).otherwise(counted)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """doc_id (with ``whole`` the row, as a struct, in its place), the five counts, the
    rates that rules may test, and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = F.struct(*[F.col(c) for c in docs.columns]) if whole else F.col(id_col)
    rows = docs.select(given.alias("doc_id"), text.alias("body")).withColumn("words", words_of(F.col("body")))
    lines = F.filter(F.split("body", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # One-element explode: a filter on a count stays above it, so counts are made once.
    counted = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("body", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("body", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("body", F.lit("[0-9]")).cast("long").alias("n_digits"),
    )
    rows = rows.select("doc_id", F.explode(F.array(counted)).alias("s")).select("doc_id", "s.*")
    rate = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.select(
        "doc_id",
        *COUNTS,
        rate("n_symbols", "n_words").alias("symbol_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("word_chars", "n_words").alias("word_length"),
        rate("n_upper", "word_chars").alias("upper_rate"),
        rate("n_marks", "n_words").alias("mark_rate"),
        rate("n_digits", "word_chars").alias("digit_rate"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))).alias("base_failed"),
    )


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Test, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(t.holds(row) for t in rule)


def _grow(rows: list[tuple[dict, bool]], features: tuple[str, ...], cuts: int, most: int) -> Rule:
    """Add the test with the best information gain until no good row is covered."""
    rule: list[Test] = []
    while len(rule) < most:
        bad = sum(y for _, y in rows)
        if not bad or bad == len(rows):
            break
        prior, best = math.log2(bad / len(rows)), (1e-9, None)
        for f in features:
            ordered = sorted((r[f], y) for r, y in rows)
            step = max(1, len(ordered) // cuts)
            below = p = 0
            for k, (v, y) in enumerate(ordered):
                below, p = below + 1, p + y
                if k + 1 < len(ordered) and ordered[k + 1][0] == v or k + 1 == len(ordered):
                    continue
                if below % step and (k + 1 < len(ordered) and ordered[k + 1][1] == y):
                    continue
                edge = (v + ordered[k + 1][0]) / 2
                for above, hit, n in ((False, p, below), (True, bad - p, len(ordered) - below)):
                    if hit and (gain := hit * (math.log2(hit / n) - prior)) > best[0]:
                        best = (gain, Test(f, above, edge))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [(r, y) for r, y in rows if best[1].holds(r)]
    return tuple(rule)


def _worth(rule: Rule, rows: list[tuple[dict, bool]]) -> tuple[float, int, int]:
    hit = [y for r, y in rows if _covers(rule, r)]
    p, n = sum(hit), len(hit) - sum(hit)
    return (p - n) / (p + n) if hit else -1.0, p, n


def learn_rules(rows: list[tuple[dict, bool]], features: tuple[str, ...] = RATIOS, cuts: int = 64, most_tests: int = 4, most_rules: int = 8, least_precision: float = 0.95, least_support: int = 3) -> list[Rule]:
    """Ordered rules for bad rows. ``rows``: statistics and whether the row is bad.

    Every third row prunes, the others grow. A rule must cover ``least_support`` bad
    rows in all, with ``least_precision`` on either part, or the covering ends."""
    left, rules = list(rows), []
    while len(rules) < most_rules:
        grow, prune = [x for k, x in enumerate(left) if k % 3], left[::3]
        rule = _grow(grow, features, cuts, most_tests)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(r, prune)[0])
        _, p, n = _worth(rule, left)
        _, pp, pn = _worth(rule, prune)
        if p < least_support or p < least_precision * (p + n) or pp < least_precision * (pp + pn):
            break
        rules.append(rule)
        left = [(r, y) for r, y in left if not _covers(rule, r)]
    return rules


def decision(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that holds, or 0."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        held = F.lit(True)
        for t in rules[k - 1]:
            held = held & t.column()
        out = F.when(held, F.lit(k)).otherwise(out)
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules from the labelled rows with the smallest hashes, ``max_labelled`` at most."""
    # At most max_labelled rows are broadcast: the limit is the proof.
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.min(label_col).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    measured = text_statistics(known.select("doc_id", "text")).where(~F.col("base_failed")).join(F.broadcast(chosen), "doc_id")
    rows = measured.select("label", *RATIOS).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()
    return learn_rules([(r.asDict(), r["label"] == 0) for r in rows])


def quality_verdicts(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts, base_failed, rule (0: none), kept."""
    return (
        text_statistics(docs, id_col, text_col)
        .withColumn("rule", decision(rules))
        .select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
    )


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and ``rules`` keep, with all columns."""
    judged = text_statistics(docs, text_col=text_col, whole=True).withColumn("rule", decision(rules))
    return judged.where(~F.col("base_failed") & (F.col("rule") == 0)).select("doc_id.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_verdicts(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
