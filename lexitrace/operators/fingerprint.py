"""Shingles, hashes, weighted queries and token streams (DataFrame to DataFrame).

A library is a table of cues: media_id, pos, start_ms, end_ms, text. Shingles never
span cues. Tokens are the words themselves, or phonetic keys of them
(``functions.phonetics``) where the language suits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FingerprintConfig
from ..functions import text as T

DEFAULT = FingerprintConfig()


def shingles(tokens: Column, size: int) -> Column:
    """All windows of ``size`` tokens, joined by spaces; none if there are fewer."""
    none = F.array().cast("array<string>")
    if size <= 0:
        return none
    windows = F.transform(F.sequence(F.lit(0), F.size(tokens) - size), lambda i: F.array_join(F.slice(tokens, i + 1, size), " "))
    return F.when(F.size(tokens) >= size, windows).otherwise(none)


def token_ngrams(tokens: Column, n: int = 2) -> Column:
    return shingles(tokens, n)


def hash_shingle(shingle: Column, algorithm: str = "md5", length: int = 16) -> Column:
    """The first ``length`` hexadecimal digits of a digest."""
    digest = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}[algorithm]
    return F.substring(digest(shingle), 1, length)


def packed(hash: Column) -> Column:
    """A hash of sixteen hexadecimal digits as one number, half as long or less."""
    return F.conv(hash, 16, -10).cast("long")


def unpacked(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def text_tokens(text: Column, config: FingerprintConfig = DEFAULT) -> Column:
    return T.tokenize(text, config.min_word_length, config.drop_stopwords)


def text_fingerprints(tokens: Column, config: FingerprintConfig = DEFAULT) -> Column:
    """array of (hash, shingle_size), by size, then place."""
    one = lambda k: F.transform(shingles(tokens, k), lambda s: F.struct(hash_shingle(s, config.hash_algorithm, config.hash_length).alias("hash"), F.lit(k).alias("shingle_size")))
    return F.concat(*[one(k) for k in config.shingle_sizes])


def cue_tokens(cues: DataFrame, config: FingerprintConfig = DEFAULT) -> DataFrame:
    """``cues`` with their tokens; a narrow step."""
    return cues.withColumn("tokens", text_tokens(F.col("text"), config))


def library_fingerprints(tokens: DataFrame, config: FingerprintConfig = DEFAULT, among: DataFrame | None = None) -> DataFrame:
    """hash, shingle_size, media_id, start_ms, end_ms: a row for each occurrence. Narrow.
    With ``among`` (``asked_shingles``, fit to broadcast) those of its shingles only; no
    others are hashed, and none is made where the numbers of its first words aren't among theirs.

    Places and sizes are exploded and words picked by place, which stays in generated code;
    outer explodes keep the planner from computing tokens twice to filter on them."""
    sizes = [k for k in config.shingle_sizes if k > 0]
    least, n = min(sizes), F.size("tokens")
    at = tokens.select("media_id", "start_ms", "end_ms", "tokens", F.explode_outer(F.when(n >= least, F.sequence(F.lit(0), n - least))).alias("i")).where(F.col("i").isNotNull())
    if among is not None:
        number = lambda words, i: F.xxhash64(*[F.get(words, i + j) for j in range(least)]).alias("head")
        heads = among.select(number(F.split("shingle", " "), F.lit(0))).distinct()
        at = at.select("*", number(F.col("tokens"), F.col("i"))).join(F.broadcast(heads), "head", "left_semi")
        at = at.select("media_id", "start_ms", "end_ms", F.slice("tokens", F.col("i") + 1, F.lit(max(sizes))).alias("tokens"), F.lit(0).alias("i"))
    each = at.select("*", F.explode_outer(F.array(*map(F.lit, sizes))).alias("shingle_size")).where(F.col("i") + F.col("shingle_size") <= n)
    word = lambda j: F.get("tokens", F.col("i") + j) if j < least else F.when(F.col("shingle_size") > j, F.get("tokens", F.col("i") + j))
    shingle = F.concat_ws(" ", *[word(j) for j in range(max(sizes))])
    if among is not None:
        each = each.withColumn("shingle", shingle).join(F.broadcast(among), "shingle", "left_semi")
        shingle = F.col("shingle")
    return each.select(hash_shingle(shingle, config.hash_algorithm, config.hash_length).alias("hash"), "shingle_size", "media_id", "start_ms", "end_ms")


def asked_shingles(windows: DataFrame, config: FingerprintConfig = DEFAULT, tokens: str | None = None) -> DataFrame:
    """shingle: the distinct shingles of ``windows`` (see ``weighted_query``), as text."""
    words = F.col(tokens) if tokens else text_tokens(F.col("text"), config)
    return windows.select(F.explode(F.concat(*[shingles(words, k) for k in config.shingle_sizes])).alias("shingle")).distinct()


def token_streams(tokens: DataFrame) -> DataFrame:
    """media_id, tokens, starts: the tokens of each media in cue order, and the start
    of the cue of each. Media without tokens have no stream."""
    gathered = tokens.where(F.size("tokens") > 0).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start_ms", "tokens"))).alias("cues"))
    return gathered.select(
        "media_id",
        F.flatten(F.transform("cues", lambda c: c["tokens"])).alias("tokens"),
        F.flatten(F.transform("cues", lambda c: F.array_repeat(c["start_ms"], F.size(c["tokens"])))).alias("starts"),
    )


def cue_lists(media: DataFrame, config: FingerprintConfig = DEFAULT) -> DataFrame:
    """media_id, cues (array of start_ms, tokens, of those that have any) of media that lie in one
    row each: media_id, cues (array of start_ms, text, in order). Narrow."""
    tokens = F.transform("cues", lambda c: F.struct(c["start_ms"].alias("start_ms"), text_tokens(c["text"], config).alias("tokens")))
    rows = media.select("media_id", F.explode_outer(F.array(tokens)).alias("cues"))  # tokens are made once
    return rows.select("media_id", F.filter("cues", lambda c: F.size(c["tokens"]) > 0).alias("cues"))


def whole_streams(lists: DataFrame) -> DataFrame:
    """``token_streams`` of ``cue_lists``, best a written table. Narrow."""
    return lists.where(F.size("cues") > 0).select(
        "media_id",
        F.flatten(F.transform("cues", lambda c: c["tokens"])).alias("tokens"),
        F.flatten(F.transform("cues", lambda c: F.array_repeat(c["start_ms"], F.size(c["tokens"])))).alias("starts"),
    )


def time_weight(fraction: Column) -> Column:
    """1 in the middle of a file, down to 0.6 at its ends."""
    return F.when(fraction.between(0.2, 0.8), 1.0).when(fraction < 0.2, 0.6 + fraction / 0.2 * 0.4).otherwise(0.6 + (1.0 - fraction) / 0.2 * 0.4)


def weighted_query(windows: DataFrame, config: FingerprintConfig = DEFAULT, tokens: str | None = None) -> DataFrame:
    """query_id, hash, weight. ``windows``: query_id, start_s, duration_s, text (or the
    column ``tokens``). A hash weighs as much as its best window."""
    fraction = F.when(F.col("duration_s") > 0, F.col("start_s") / F.col("duration_s")).otherwise(0.5)
    words = F.col(tokens) if tokens else text_tokens(F.col("text"), config)
    each = windows.select("query_id", time_weight(fraction).alias("weight"), F.explode(text_fingerprints(words, config)).alias("f"))
    return each.groupBy("query_id", F.col("f.hash").alias("hash")).agg(F.max("weight").alias("weight"))
