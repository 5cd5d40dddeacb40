"""Language of a text from letter trigrams, learnt from labelled texts.

A model is a table: gram, weights (log-likelihoods, one for each language, by name). Words are
counted before they are cut into grams, in training over all texts and in scoring in each, so
that repeats are cut once. All of it is joins and sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise

#: Added to each count; grams of a model at most, the most frequent ones; letters of a text at least.
PSEUDO, MOST_GRAMS, MIN_CHARS = 0.5, 50_000, 40


def letter_words(text: Column) -> Column:
    """Runs of letters in lower case; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")


def word_grams(word: Column) -> Column:
    """Trigrams of a word between spaces, with repeats."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


@dataclass
class LanguageModel:
    """``grams``: gram, weights. Languages are in the order of the weights."""

    languages: list[str]
    grams: DataFrame


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", most_grams: int = MOST_GRAMS) -> LanguageModel:
    """From rows with a language; those without are left out. Of equally frequent grams the
    ones that sort first are kept. Languages, few as they are, reach the driver. Counts of
    grams are written, so that texts are read once."""
    words = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(letter_words(F.col(text))).alias("word"))
    words = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))
    counts = materialise(words.select("lang", "c", F.explode(word_grams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    kept = counts.groupBy("gram").agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by")).orderBy(F.desc("all"), "gram").limit(most_grams)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
    names = sorted(totals)
    weight = lambda k: F.log((F.coalesce(F.try_element_at("by", F.lit(k)), F.lit(0)) + PSEUDO) / (totals[k] + PSEUDO * most_grams))
    return LanguageModel(names, materialise(kept.select("gram", F.array(*map(weight, names)).cast("array<double>").alias("weights"))))


def detect(texts: DataFrame, model: LanguageModel, key: str, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """key, language: the likeliest one; null for texts of under ``min_chars`` or without a
    known gram. Of equal ones (to six decimals) the name that sorts first. A key that
    repeats has one row, for its texts together. The grams of a model, few as they are, are
    broadcast, so that texts dealt by their key are not shuffled again."""
    if not model.languages:
        return texts.select(key).distinct().withColumn("language", F.lit(None).cast("string"))
    n = range(len(model.languages))
    words = texts.select(key, F.explode(letter_words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("c"))
    grams = words.select(key, "c", F.explode(word_grams(F.col("word"))).alias("gram")).join(F.broadcast(model.grams), "gram")
    met = grams.groupBy(key).agg(*[F.round(F.sum(F.col("c") * F.get("weights", F.lit(k))), 6).alias(f"s{k}") for k in n])
    best = F.greatest(*[F.col(f"s{k}") for k in n]) if len(n) > 1 else F.col("s0")
    language = F.coalesce(*[F.when(F.col(f"s{k}") == best, name) for k, name in enumerate(model.languages)])
    long = texts.groupBy(key).agg((F.max(F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))) >= min_chars).alias("long"))
    found = met.select(F.col(key).alias("__key"), language.alias("language"))
    return long.join(found, long[key].eqNullSafe(found["__key"]), "left").select(key, F.when(F.col("long"), F.col("language")).alias("language"))
