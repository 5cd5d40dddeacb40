"""From ranked candidates to a verdict on each file.

Candidates: query_id, media_id, confidence, match_count, rank, joined with media. Files:
query_id, filename, duration_s, n_words and, if known, expected_show, title, season,
episode of the file name.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..config import MatchConfig
from ..functions import text as T

DEFAULT = MatchConfig()


@F.pandas_udf(ST.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings; 0 if either is empty or null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype=float)


#: A title counts from this similarity on.
CLOSE = 0.6


def letter_bound(a: Column, b: Column) -> Column:
    """No less than ``similarity_ratio``: letters that both hold, in any order."""
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    return 2.0 * shared / (F.length(a) + F.length(b))


def title_ratios(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, ratio of the different pairs in two columns whose similarity may reach
    ``CLOSE``. Equal titles and the bound are settled by expressions; what is left is
    compared by the exact measure, each pair once."""
    pairs = rows.where((F.col(a) != "") & (F.col(b) != "")).select(a, b).distinct()
    near = pairs.where((F.col(a) == F.col(b)) | (letter_bound(F.col(a), F.col(b)) >= CLOSE))
    same = near.where(F.col(a) == F.col(b)).withColumn("ratio", F.lit(1.0))
    return same.unionByName(near.where(F.col(a) != F.col(b)).withColumn("ratio", similarity_ratio(F.col(a), F.col(b))))


def metadata_boosts(candidates: DataFrame) -> DataFrame:
    """Adds 0.15 for an equal show and up to 0.10 for a similar episode title, capped at
    1, and ranks anew. Columns: expected_show, query_title, show_title, episode_title."""
    show = (T.normalise_title(F.col("expected_show")) == T.normalise_title(F.col("show_title"))) & (T.normalise_title(F.col("show_title")) != "")
    out = candidates.withColumn("show_match", show).withColumns({"__a": T.normalise_title(F.col("query_title")), "__b": T.normalise_title(F.col("episode_title"))})
    out = out.join(title_ratios(out, "__a", "__b"), ["__a", "__b"], "left").withColumn("title_ratio", F.coalesce("ratio", F.lit(0.0))).drop("__a", "__b", "ratio")
    raised = F.when(F.col("show_match"), F.least(F.lit(1.0), F.col("confidence") + 0.15)).otherwise(F.col("confidence"))
    close = F.col("title_ratio") >= CLOSE
    out = out.withColumn("confidence", F.when(close, F.least(F.lit(1.0), raised + 0.10 * F.col("title_ratio"))).otherwise(raised))
    notes = F.concat_ws(", ", F.when(F.col("show_match"), "show match +15%"), F.when(close, F.concat(F.lit("episode title +"), F.bround(10 * F.col("title_ratio")).cast("int").cast("string"), F.lit("%"))))
    # Nine decimals count, as in the stages: equal matches stay in their order.
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("confidence", 9)), F.desc("match_count"), "rank")
    return out.withColumn("boost_notes", notes).withColumn("rank", F.row_number().over(order)).drop("show_match", "title_ratio")


def _swap(ranked: DataFrame, distance: Column, near: Column) -> DataFrame:
    """Swaps the first two of a query where they are ``near`` and the second alone has a
    distance, or the smaller one."""
    by = W.partitionBy("query_id")
    at = lambda c, k: F.max(F.when(F.col("rank") == k, c)).over(by)
    out = ranked.withColumn("__d", distance)
    out = out.withColumns({"__d1": at(F.col("__d"), 1), "__d2": at(F.col("__d"), 2), "__gap": at(F.col("confidence"), 1) - at(F.col("confidence"), 2)})
    swap = near & F.col("__d2").isNotNull() & (F.col("__d1").isNull() | (F.col("__d2") < F.col("__d1")))
    rank = F.when(swap & (F.col("rank") <= 2), 3 - F.col("rank")).otherwise(F.col("rank"))
    return out.withColumn("rank", rank).drop("__d", "__d1", "__d2", "__gap")


def tie_breaks(ranked: DataFrame, config: MatchConfig = DEFAULT) -> DataFrame:
    """Between near-equal leaders first the closer runtime, then the closer density of
    dialogue decides. Columns: duration_s, n_words, duration_seconds, n_tokens."""
    by = W.partitionBy("query_id")
    first = F.max(F.when(F.col("rank") == 1, F.col("confidence"))).over(by) - F.max(F.when(F.col("rank") == 2, F.col("confidence"))).over(by)
    known = F.col("duration_seconds") > 0
    # The density test runs only where the first gap was near; a swap keeps it near.
    ranked = ranked.withColumn("__near", (F.col("duration_s") > 0) & F.coalesce(first < config.min_exact_margin, F.lit(False)))
    ranked = _swap(ranked, F.when(known, F.abs(F.col("duration_s") - F.col("duration_seconds"))), F.col("__near"))
    asked = T.dialogue_density(F.col("n_words"), F.col("duration_s"))
    has = T.dialogue_density(F.col("n_tokens"), F.col("duration_seconds"))
    ranked = _swap(ranked, F.when(known & (F.col("n_tokens") > 0) & (asked > 0), F.abs(asked - has)), F.col("__near") & (F.col("n_words") > 0))
    return ranked.drop("__near")


def leaders(ranked: DataFrame) -> DataFrame:
    """The first of each query, and ``margin`` to the second (null if alone)."""
    by = W.partitionBy("query_id").orderBy("rank")
    return ranked.withColumn("margin", F.col("confidence") - F.lead("confidence").over(by)).where(F.col("rank") == 1)


def cascade(exact: DataFrame, fuzzy: DataFrame, ngram: DataFrame, replace_below: float = 0.40) -> DataFrame:
    """One guess for each query: exact, or fuzzy where exact has none; an n-gram guess
    replaces one below ``replace_below`` if its ``raw`` confidence, that of the stage's first
    before boosts, is strictly better. All three: leaders with boost_notes. The notes of a
    guess that was replaced stay, as ``early_notes``."""
    keep = ["query_id", "media_id", "confidence", "match_count", "boost_notes", "margin"]
    tag = lambda df, name, *more: df.select(*keep, *more, F.lit(name).alias("method"))
    # A fuzzy leader's margin isn't carried to the gates.
    early = tag(exact, "phonetic").unionByName(tag(fuzzy.join(exact, "query_id", "left_anti"), "fuzzy").withColumn("margin", F.lit(None).cast("double")))
    late = tag(ngram, "ngram", "raw").select("query_id", *[F.col(c).alias(f"late_{c}") for c in [*keep[1:], "raw", "method"]])
    both = early.join(late, "query_id", "full_outer")
    take = F.col("late_raw").isNotNull() & (F.col("confidence").isNull() | ((F.col("confidence") < replace_below) & (F.col("late_raw") > F.col("confidence"))))
    pick = lambda c: F.when(take, F.col(f"late_{c}")).otherwise(F.col(c)).alias(c)
    margin = F.when(take, F.coalesce("late_margin", "margin")).otherwise(F.col("margin")).alias("margin")
    notes = F.when(take, F.nullif(F.col("boost_notes"), F.lit(""))).alias("early_notes")
    return both.select("query_id", *[pick(c) for c in ("media_id", "confidence", "match_count", "boost_notes", "method")], margin, notes)


def with_raw(leading: DataFrame, found: DataFrame) -> DataFrame:
    """Leaders after boosts with ``raw``, the best confidence of a query before them."""
    return leading.join(found.groupBy("query_id").agg(F.max("confidence").alias("raw")), "query_id")


def review_threshold(base: float, match_count: Column, boosted: Column) -> Column:
    """Lower for many matches and for metadata that agree."""
    factor = F.when(match_count >= 15, 0.70).when(match_count >= 8, 0.85).otherwise(1.0)
    return F.lit(base) * factor * F.when(boosted, 0.85).otherwise(1.0)


def _whole(x: Column) -> Column:
    return F.bround(x).cast("long").cast("string")


def verdicts(files: DataFrame, guesses: DataFrame, config: MatchConfig = DEFAULT, runtimes: DataFrame | None = None) -> DataFrame:
    """A row for each file. ``guesses``: query_id, media columns, confidence, match_count,
    margin, method, boost_notes and, if known, early_notes. ``runtimes``: episode_id, minutes.
    Files may have votes and total_samples, the windows with speech and all, and input_pos."""
    blank = {"votes": "int", "total_samples": "int", "input_pos": "long"}
    files = files.withColumns({c: F.lit(None).cast(t) for c, t in blank.items() if c not in files.columns})
    if "early_notes" not in guesses.columns:
        guesses = guesses.withColumn("early_notes", F.lit(None).cast("string"))
    out = files.join(guesses, "query_id", "left")
    none = F.col("confidence").isNull()
    if runtimes is None:
        out = out.withColumn("expected_min", F.lit(None).cast("double"))
    else:
        wanted = runtimes.select(F.upper("episode_id").alias("__id"), F.col("minutes").cast("double").alias("expected_min")).dropDuplicates(["__id"])
        out = out.join(wanted, F.upper(T.episode_id(F.col("season"), F.col("episode"))) == F.col("__id"), "left").drop("__id")
    boosted = F.coalesce(F.col("boost_notes"), F.lit("")) != ""
    out = out.withColumn("threshold", review_threshold(config.review_confidence, F.col("match_count"), boosted))
    low = F.coalesce(F.col("confidence") < F.col("threshold"), F.lit(False))
    unclear = F.coalesce((F.col("margin") < config.min_exact_margin) & (F.col("confidence") < 0.90), F.lit(False))
    out = out.withColumn("confident", ~none & ~low & ~unclear)
    confident = F.col("confident")
    minutes = F.col("duration_s") / 60.0
    off_run = F.coalesce(~none & (F.abs(minutes - F.col("expected_min")) > config.runtime_tolerance_min), F.lit(False))
    expected = F.col("duration_seconds")
    rel = F.when((F.col("duration_s") > 0) & (expected > 0), F.abs(F.col("duration_s") - expected) / expected)
    off = F.coalesce(~none & (rel > config.duration_tolerance), F.lit(False))
    sure = F.coalesce(F.col("duration_source").isin("tvmaze", "manual", "online"), F.lit(False))
    review = ~confident | (off_run & ~confident) | (off & sure & ~confident)
    best_id = T.episode_id(F.col("season"), F.col("episode"))
    placed = F.col("file_season").isNotNull() & F.col("file_episode").isNotNull()
    right = F.coalesce(placed & (F.col("file_season") == F.col("season")) & (F.col("file_episode") == F.col("episode")), F.lit(False))
    status = F.when(none | ~confident, "unknown").when(right, "correct").otherwise("rename")
    mins = lambda s: F.concat(_whole(s / 60.0), F.lit("m"))
    percent = F.concat(_whole(rel * 100), F.lit("% off"))
    #: The texts of notes.
    notes = F.concat_ws(
        "; ",
        "early_notes",
        F.when(boosted, F.col("boost_notes")),
        F.when(F.col("method") == "ngram", "matched via n-gram fallback"),
        F.when(none, F.when(F.col("votes") == 0, "no speech recognised").otherwise("no match")),
        F.when(low, F.concat(F.lit("low confidence "), _whole(F.col("confidence") * 100), F.lit("%"))),
        F.when(unclear, F.concat(F.lit("ambiguous: runner-up within "), _whole(F.col("margin") * 100), F.lit("%"))),
        F.when(off_run, F.concat(F.lit("runtime "), _whole(minutes), F.lit("m vs expected "), F.col("expected_min").cast("string"), F.lit("m"))),
        F.when(off & sure & ~confident, F.concat(F.lit("duration mismatch: file is "), mins(F.col("duration_s")), F.lit(", episode should be ~"), mins(expected), F.lit(" ("), percent, F.lit(")")))
        .when(off & sure, F.concat(F.lit("length differs: file is "), mins(F.col("duration_s")), F.lit(" vs listed ~"), mins(expected), F.lit(" ("), percent, F.lit(")")))
        .when(off, F.concat(F.lit("approx duration off ~"), _whole(rel * 100), F.lit("% (subtitle estimate ~"), mins(expected), F.lit(")"))),
        F.when(status == "rename", F.when(placed, F.concat(F.lit("named "), T.episode_id(F.col("file_season"), F.col("file_episode")), F.lit(" but matches "), best_id)).otherwise("no S/E in filename")),
    )
    show = F.coalesce("show_title", "media_title")
    suggested = F.when(none, "").otherwise(T.suggested_name(show, F.col("season"), F.col("episode"), F.col("episode_title"), T.extension(F.col("filename"))))
    return out.select(
        "query_id",
        "filename",
        F.when(~none, best_id).alias("episode_id"),
        show.alias("title"),
        F.coalesce("episode_title", F.lit("")).alias("episode_title"),
        "season",
        "episode",
        status.alias("name_status"),
        suggested.alias("suggested_filename"),
        F.coalesce(F.round("confidence", 4), F.lit(0.0)).alias("confidence"),
        F.coalesce("method", F.lit("")).alias("method"),
        F.round("duration_s", 1).alias("duration_s"),
        review.alias("needs_review"),
        notes.alias("notes"),
        F.when(~none, F.col("votes")).alias("votes"),
        F.when(~none, F.col("total_samples")).alias("total_samples"),
        "input_pos",
    )


# -- browsing results -------------------------------------------------------------------


def status_bucket(needs_review: Column, name_status: Column) -> Column:
    return F.when(needs_review | (name_status == "unknown"), "Review").when(name_status == "correct", "Correct").otherwise("Rename")


def find_results(results: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    """Rows that hold ``text`` in a visible column, in one bucket."""
    words = F.lower(F.concat_ws(" ", "filename", "episode_id", "episode_title", "suggested_filename"))
    out = results.where(words.contains(text.strip().lower()))
    return out.where(status_bucket(F.col("needs_review"), F.col("name_status")) == status) if status else out


def status_counts(results: DataFrame) -> DataFrame:
    """bucket, n, and a row 'All' (0 without rows)."""
    bucket = status_bucket(F.col("needs_review"), F.col("name_status"))
    names = results.sparkSession.createDataFrame([("All",), ("Rename",), ("Correct",), ("Review",)], "bucket string")
    counted = results.select(F.explode(F.array(bucket, F.lit("All"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sort_order(results: DataFrame, column: str, ascending: bool = True) -> list[Column]:
    """The order by a column: text without case; an episode by season and number, unknown ones as -1;
    status by its bucket, agreement by the share of votes (0 without samples)."""
    number = lambda c: F.coalesce(F.col(c), F.lit(-1))
    keys = {
        "episode_id": [number("season"), number("episode")],
        "season": [number("season")],
        "episode": [number("episode")],
        "status": [status_bucket(F.col("needs_review"), F.col("name_status"))],
        "agreement": [F.coalesce(F.try_divide("votes", "total_samples"), F.lit(0.0))],
    }.get(column)
    if keys is None:
        keys = [F.lower(F.coalesce(column, F.lit(""))) if dict(results.dtypes)[column] == "string" else F.col(column)]
    return [*[k.asc() if ascending else k.desc() for k in keys], F.col("query_id")]


def sort_results(results: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """``results`` in the order of ``sort_order``."""
    return results.orderBy(*sort_order(results, column, ascending))


def title_mismatch(filename: Column, title: Column) -> Column:
    """Whether a file's own episode title differs from ``title``; false if either is none."""
    own = T.parse_episode(filename)["episode_title"]
    return F.coalesce(own.isNotNull() & (F.trim(title) != "") & ~T.same_title(own, title), F.lit(False))


def rename_plan(results: DataFrame) -> DataFrame:
    """filename, target (Show/Season NN/name) for rows with season and episode."""
    folder = F.format_string("Season %02d", "season")
    show = T.replace_illegal(F.coalesce("title", F.lit("Unknown")))
    return results.where(F.col("season").isNotNull() & F.col("episode").isNotNull()).select("filename", folder.alias("season_dir"), F.concat_ws("/", show, folder, "suggested_filename").alias("target"))


def summary(results: DataFrame) -> DataFrame:
    """One row: files, confident, correct, rename, review."""
    count = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    return results.agg(F.count(F.lit(1)).alias("files"), count(~F.col("needs_review"), "confident"), count(F.col("name_status") == "correct", "correct"), count(F.col("name_status") == "rename", "rename"), count(F.col("needs_review"), "review"))
