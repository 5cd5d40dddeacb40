"""Ranking of media for queries: exact hashes, ordered tokens, sets of n-grams.

All stages take whole batches of queries and return query_id, media_id, confidence,
match_count and query_count with a rank; ties go to the smaller media_id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import FuzzyConfig, MatchConfig, NgramConfig
from ..sources.scratch import materialise
from . import bitlcs
from .fingerprint import token_ngrams


#: A group is cut into stretches of so many windows (or gaps) of time, a task's share.
STRETCH = 64


def _ticks(hits: DataFrame, by: list[str], ts: str, span: int) -> DataFrame:
    """by, ts, m, part: the hits at each time, added up first, and its stretch."""
    each = hits.where(F.col(ts).isNotNull()).groupBy(*by, ts).agg(F.count(F.lit(1)).alias("m"))
    return each.withColumn("part", F.floor(F.col(ts) / F.lit(span)))


def clusters(hits: DataFrame, by: list[str], ts: str = "start_ms", window_ms: int = 30_000, stretch: int = STRETCH) -> DataFrame:
    """For each group: ``best``, the most hits in any span of ``window_ms``, and the first
    such span (null if best is 1). Null times don't count. Groups are dealt out by stretches
    of time; what lies a window before a stretch is counted in it as well."""
    span = stretch * max(1, window_ms)
    ticks = _ticks(hits, by, ts, span)
    late = F.col(ts) >= (F.col("part") + 1) * span - window_ms
    both = ticks.select(*by, ts, "m", F.explode(F.array(F.struct("part", F.lit(True).alias("own")), F.when(late, F.struct((F.col("part") + 1).alias("part"), F.lit(False).alias("own"))))).alias("p")).where(F.col("p").isNotNull())
    order = W.partitionBy(*by, "part").orderBy(ts).rangeBetween(-window_ms, W.currentRow)
    spans = both.select(*by, ts, "m", "p.part", "p.own").select(*by, "own", F.col(ts).alias("end"), F.sum("m").over(order).alias("n"), F.min(ts).over(order).alias("start")).where("own")
    best = spans.groupBy(*by).agg(F.max("n").alias("best"), F.min_by(F.struct("start", "end"), F.struct(-F.col("n"), F.col("end"))).alias("span"))
    return best.select(*by, "best", F.when(F.col("best") > 1, F.col("span.start")).alias("win_start"), F.when(F.col("best") > 1, F.col("span.end")).alias("win_end"))


def longest_runs(hits: DataFrame, by: list[str], ts: str = "start_ms", gap_ms: int = 4_000, stretch: int = STRETCH) -> DataFrame:
    """For each group: ``run``, the most hits in a row with gaps of ``gap_ms`` at most. Runs
    are found in stretches of time; the first and last of each are then joined over edges."""
    ticks = _ticks(hits, by, ts, stretch * max(1, gap_ms))

    def islands(rows: DataFrame, keys: list[str]) -> DataFrame:
        """keys, begin, end, n of runs of rows (begin, end, n) in a row."""
        order = W.partitionBy(*keys).orderBy("begin")
        new = F.when(F.col("begin") - F.lag("end").over(order) > gap_ms, 1).otherwise(0)
        marked = rows.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        return marked.groupBy(*keys, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("n").alias("n"))

    keys = [*by, "part"]
    inner = islands(ticks.select(*keys, F.col(ts).alias("begin"), F.col(ts).alias("end"), F.col("m").alias("n")), keys)
    told = inner.groupBy(*keys).agg(F.max("n").alias("most"), F.min_by(F.struct("begin", "end", "n"), "begin").alias("first"), F.max_by(F.struct("begin", "end", "n"), "begin").alias("last"))
    edges = told.select(*by, "most", F.explode(F.array_distinct(F.array("first", "last"))).alias("e")).select(*by, "most", "e.*")
    joined = islands(edges.drop("most"), by).select(*by, "n")
    return joined.unionByName(edges.select(*by, F.col("most").alias("n"))).groupBy(*by).agg(F.max("n").alias("run"))


def cluster_bonus(best: Column, match_count: Column) -> Column:
    return F.coalesce(F.least(F.lit(0.25), best / F.greatest(F.lit(1), match_count) * 0.25), F.lit(0.0))


def run_bonus(run: Column) -> Column:
    return F.when(run > 1, 0.20 * (1.0 - F.exp(-(run - 1) / 5.0))).otherwise(0.0)


def idf_mean(df: DataFrame, n_media: int) -> DataFrame:
    """mean: one row, that of the idf of all hashes, from how many have each frequency."""
    return idf_mean_of(df.groupBy("df").agg(F.count(F.lit(1)).alias("k")), n_media)


def idf_mean_of(counts: DataFrame, n_media: int) -> DataFrame:
    """``idf_mean`` from ``counts`` (df, k): how many hashes have each frequency, in any rows."""
    idf = F.log((1.0 + n_media) / (1.0 + F.col("df"))) + 1.0
    return counts.groupBy("df").agg(F.sum("k").alias("k")).agg((F.sum(F.col("k") * idf) / F.sum("k")).alias("mean"))


def idf_factors(df: DataFrame, n_media: int, mean: DataFrame | None = None) -> DataFrame:
    """hash, factor: idf over its mean, held in 0.35 to 3; no rows for under 3 media. With
    ``mean`` (``idf_mean`` of all hashes) ``df`` may hold just the hashes that are asked for."""
    idf = F.log((1.0 + n_media) / (1.0 + F.col("df"))) + 1.0
    each = df.where(F.lit(n_media >= 3)).withColumn("idf", idf)
    mean = idf_mean(df, n_media) if mean is None else mean
    return each.join(F.broadcast(mean), F.lit(True)).select("hash", F.least(F.lit(3.0), F.greatest(F.lit(0.35), F.col("idf") / F.col("mean"))).alias("factor"))


def apply_idf(query: DataFrame, factors: DataFrame) -> DataFrame:
    """``query``, best a written table, with weights times factors. Only factors of its
    hashes are joined: a small query is broadcast to them by its size."""
    used = factors.join(query.select("hash").distinct(), "hash", "left_semi")
    return query.join(used, "hash", "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def coverage(query: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, media_id, base, match_count, query_count: the share of a query's weight
    that distinct hits cover."""
    total = query.groupBy("query_id").agg(F.greatest(F.sum("weight"), F.lit(1e-9)).alias("total"), F.count(F.lit(1)).alias("query_count"))
    distinct = hits.select("query_id", "hash", "media_id").distinct().join(query, ["query_id", "hash"])
    found = distinct.groupBy("query_id", "media_id").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("match_count"))
    return found.join(total, "query_id").select("query_id", "media_id", (F.col("w") / F.col("total")).alias("base"), "match_count", "query_count")


def top(scored: DataFrame, n: int) -> DataFrame:
    """The best ``n`` of each query, with rank. Nine decimals count, so that the order in
    which shares were summed decides no tie."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("confidence", 9)), F.desc("match_count"), "media_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def exact_scores(query: DataFrame, hits: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Coverage plus the bonuses of clusters and runs, 1 at most. ``hits`` is read three
    times: write it, or the index is probed as often."""
    by = ["query_id", "media_id"]
    scored = coverage(query, hits).join(clusters(hits, by, window_ms=config.window_ms), by, "left").join(longest_runs(hits, by, gap_ms=config.run_gap_ms), by, "left")
    confidence = F.least(F.lit(1.0), F.col("base") + cluster_bonus(F.col("best"), F.col("match_count")) + run_bonus(F.col("run")))
    return top(scored.withColumn("confidence", confidence), config.top_n)


# -- ordered tokens ---------------------------------------------------------------------


def lis_length(values: list[int]) -> int:
    """Length of the longest strictly increasing subsequence."""
    tails: list[int] = []
    for v in values:
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def alignment(query: list[str], reference: list[str], index: dict[str, list[int]] | None = None) -> tuple[int, int, int]:
    """(length of the longest common subsequence, first and last place in the reference
    of any token that both hold); places -1 if there is none."""
    if index is None:
        index = defaultdict(list)
        for i, t in enumerate(reference):
            index[t].append(i)
    places = [p for t in query for p in reversed(index.get(t, ()))]
    return (lis_length(places), min(places), max(places)) if places else (0, -1, -1)


def lis_fold(places: Column) -> Column:
    """``lis_length`` as one expression, for short arrays and for checks."""
    none = F.array().cast("array<int>")

    def step(tails: Column, x: Column) -> Column:
        below = F.filter(tails, lambda y: y < x)
        return F.concat(below, F.array(x), F.slice(tails, F.size(below) + 2, F.greatest(F.size(tails) - F.size(below) - 1, F.lit(0))))

    return F.size(F.aggregate(F.transform(places, lambda p: p.cast("int")), none, step))


#: Identifiers or grams that are broadcast; more meet their table by a shuffle.
BROADCAST = 1 << 20
#: Tokens, the most frequent ones, whose weights are broadcast, and streams in a task's share.
FREQUENT, SHARE = 1 << 18, 4096


def _among(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is in ``few``, best a written table. Rows stay where they lie
    unless ``few`` is too much to broadcast."""
    ids = few.select(key).distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, key, "left_semi")


def _met_by(queries: DataFrame, streams: DataFrame) -> DataFrame:
    """``streams``, none of which is read for no queries."""
    return streams.where(F.lit(False)) if queries.isEmpty() else streams


#: Postings of a token that are kept as its champions, and pairs of a query they seed.
CHAMPIONS, SEEDS = 16, 4


def token_postings(streams: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """token, media_id, n: how often each stream holds a token, or one of ``words`` (token)."""
    each = streams.select("media_id", F.explode("tokens").alias("token"))
    each = each if words is None else each.join(words.select("token").distinct(), "token", "left_semi")
    return each.groupBy("token", "media_id").agg(F.count(F.lit(1)).alias("n"))


def aligned_pairs(pairs: DataFrame, queries: DataFrame, streams: DataFrame, block: int = 256) -> DataFrame:
    """query_id, media_id, match_count, query_count, win_start, win_end of ``pairs`` (query_id,
    media_id, least), each once, whose match has ``least`` tokens. A stream of a pair travels
    with its queries, some ``block`` of them in a row, so one that all queries meet is split;
    streams without a pair don't travel."""
    asked = queries.select("query_id", "tokens")
    blocks = F.lit(max(1, asked.count() // block))
    pairs = materialise(pairs.select("query_id", "media_id", "least"))
    both = pairs.join(asked, "query_id")
    rows = both.groupBy("media_id", F.pmod(F.xxhash64("query_id"), blocks).alias("block")).agg(F.collect_list(F.struct("query_id", "tokens", F.col("least").cast("long").alias("least"))).alias("asked"))
    met, near = pairs.select("media_id").distinct(), streams.select("media_id", "tokens", "starts")
    if (k := met.count()) <= BROADCAST:
        near = near.join(F.broadcast(met), "media_id", "left_semi")
    near = near.repartition(max(pairs.sparkSession.sparkContext.defaultParallelism, k // SHARE), "media_id")
    held = rows.join(near, "media_id").select("media_id", "tokens", "starts", "asked")
    return held.mapInArrow(bitlcs.aligned, bitlcs.SHAPE)


def asked_postings(queries: DataFrame, streams: DataFrame) -> DataFrame:
    """``token_postings`` of the tokens of ``queries``, written: what one batch needs of them."""
    return materialise(token_postings(streams, materialise(queries.select(F.explode("tokens").alias("token")).distinct())))


def _asked_tokens(queries: DataFrame, df: DataFrame) -> DataFrame:
    """query_id, token, k, df, before, known: the distinct tokens of each query that streams
    hold, ``k`` times in the query; those before it when rare ones come first, with repeats,
    and all of them."""
    each = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("k"))
    order = W.partitionBy("query_id").orderBy("df", "token")
    found = each.join(df.select("token", "df"), "token")
    return found.select("query_id", "token", "k", "df", (F.sum("k").over(order) - F.col("k")).alias("before"), F.sum("k").over(W.partitionBy("query_id")).alias("known"))


def ordered_candidates(tokens: DataFrame, least: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, media_id, least: the streams that may share ``least`` (query_id, least) tokens
    with a query. Of ``known`` tokens, the rarest known - least + 1 must hold a shared one;
    more tokens join them as long as that no more than doubles the postings to read, as
    those left then say more. A pair needs as many shared as the tokens left over can't give."""
    each = tokens.join(least, "query_id").withColumn("must", F.col("before") < F.col("known") - F.col("least") + 1)
    run = W.partitionBy("query_id").orderBy("df", "token")
    each = each.withColumns({"read": F.sum("df").over(run), "most": 2 * F.sum(F.when(F.col("must"), F.col("df"))).over(W.partitionBy("query_id"))})
    used = each.where(F.col("must") | (F.col("read") <= F.col("most")))
    used = used.withColumn("need", F.col("least") - F.col("known") + F.sum("k").over(W.partitionBy("query_id")))
    met = used.join(postings, "token").groupBy("query_id", "media_id").agg(F.sum(F.least("k", "n")).alias("shared"), F.any_value("need").alias("need"), F.any_value("least").alias("least"))
    return met.where(F.col("shared") >= F.col("need")).select("query_id", "media_id", "least")


def _scored(found: DataFrame, config: FuzzyConfig) -> DataFrame:
    share = F.least(F.lit(1.0), F.col("match_count") / F.col("query_count") * config.weight)
    return found.select("query_id", "media_id", share.alias("confidence"), "match_count", "query_count", "win_start", "win_end")


def lcs_scores(queries: DataFrame, streams: DataFrame, config: FuzzyConfig = FuzzyConfig(), top_n: int = 5, block: int = 256, postings: DataFrame | None = None, floor: float = 0.0) -> DataFrame:
    """The ``top_n`` best ordered matches of each query, by the length of the longest common
    subsequence. ``queries``: query_id, tokens, an id once; ``streams``: media_id, tokens,
    starts; ``postings``, of a library, saves making those of the queries' tokens. Matches under ``floor`` (a
    confidence) may be left out.

    Matches with a few champions of each token, the streams that hold it most often, give each
    query a length that its first ``top_n`` reach at least. Streams that can't share as
    many tokens, by an inverted index and counts, are never aligned. Nothing is collected;
    joins are on tokens and identifiers."""
    if postings is None:
        postings = asked_postings(queries, streams)
    asked = materialise(queries.select("query_id", "tokens").where(F.size("tokens") > 0))
    df = postings.join(asked.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi")
    champion = F.row_number().over(W.partitionBy("token").orderBy(F.desc("n"), "media_id"))
    tokens = materialise(_asked_tokens(asked, df.groupBy("token").agg(F.count(F.lit(1)).alias("df"))))
    champions = df.withColumn("place", champion).where(F.col("place") <= CHAMPIONS).drop("place")
    met = tokens.join(champions, "token").groupBy("query_id", "media_id").agg(F.sum(F.least("k", "n")).alias("shared"))
    seed = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("shared"), "media_id"))
    seeds = met.withColumn("place", seed).where(F.col("place") <= SEEDS * top_n).select("query_id", "media_id", F.lit(1).alias("least"))
    reached = aligned_pairs(seeds, asked, streams, block).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("match_count"))))
    reached = reached.where(F.col("place") == top_n).select("query_id", "match_count")
    # A floor in tokens, a hair lower, so that rounding leaves no match out.
    enough = F.ceil(F.size("tokens") * (floor / config.weight) - 1e-6)
    least = asked.select("query_id", enough.alias("enough")).join(reached, "query_id", "left").select("query_id", F.greatest(F.lit(1), "enough", F.coalesce("match_count", F.lit(1))).cast("long").alias("least"))
    pairs = ordered_candidates(tokens, materialise(least), postings)
    return top(_scored(aligned_pairs(pairs, asked, streams, block), config), top_n)


def scoped_pairs(queries: DataFrame, streams: DataFrame, scope: DataFrame) -> DataFrame:
    """query_id, media_id of the candidates in ``scope`` that have a stream."""
    wanted = scope.select("query_id", "media_id").distinct().join(queries.select("query_id"), "query_id", "left_semi")
    return materialise(wanted.join(streams.select("media_id"), "media_id", "left_semi").select("query_id", "media_id"))


def pair_lcs_scores(pairs: DataFrame, queries: DataFrame, streams: DataFrame, config: FuzzyConfig = FuzzyConfig(), top_n: int = 5, floor: float = 0.0, postings: DataFrame | None = None) -> DataFrame:
    """``lcs_scores`` of given pairs (query_id, media_id) only. Of these, pairs that can't share
    as many tokens as the floor asks are never aligned."""
    asked = materialise(queries.select("query_id", "tokens").where(F.size("tokens") > 0).join(pairs.select("query_id").distinct(), "query_id", "left_semi"))
    postings = asked_postings(asked, streams) if postings is None else postings
    enough = F.greatest(F.lit(1), F.ceil(F.size("tokens") * (floor / config.weight) - 1e-6)).cast("long")
    tokens = materialise(_asked_tokens(asked, postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))))
    near = ordered_candidates(tokens, asked.select("query_id", enough.alias("least")), postings).join(pairs, ["query_id", "media_id"], "left_semi")
    return top(_scored(aligned_pairs(near, asked, streams), config), top_n)


def fuzzy_stage(queries: DataFrame, streams: DataFrame, config: FuzzyConfig = FuzzyConfig(), top_n: int = 5, scope: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """Ordered matches of queries with enough tokens, above the least ratio; nothing for
    a query whose best two are closer than the margin. ``scope`` (query_id, media_id) limits
    a query to its candidates; one without candidates that have a stream meets them all."""
    asked = queries.where(F.size("tokens") >= config.min_query_tokens)
    streams = _met_by(asked, streams)
    floor = config.min_lcs_ratio
    if scope is None:
        scored = lcs_scores(asked, streams, config, top_n, postings=postings, floor=floor)
    else:
        pairs = scoped_pairs(asked, streams, scope)
        postings = asked_postings(asked, streams) if postings is None else postings
        wide = lcs_scores(asked.join(pairs, "query_id", "left_anti"), streams, config, top_n, postings=postings, floor=floor)
        scored = pair_lcs_scores(pairs, asked, streams, config, top_n, floor, postings).unionByName(wide)
    return clear_winners(scored.where(F.col("confidence") >= config.min_lcs_ratio), config.min_margin)


def clear_winners(ranked: DataFrame, margin: float) -> DataFrame:
    """Rows of queries whose first is ``margin`` ahead of the second, or alone."""
    gap = F.max(F.when(F.col("rank") == 1, F.col("confidence"))).over(W.partitionBy("query_id")) - F.max(F.when(F.col("rank") == 2, F.col("confidence"))).over(W.partitionBy("query_id"))
    return ranked.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= margin)).drop("gap")


# -- sets of n-grams --------------------------------------------------------------------


def token_frequency(streams: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """token, df: the streams that hold it, or those of each group ``by``."""
    return streams.select(*by, F.explode(F.array_distinct("tokens")).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("df"))


def idf_of(tokens: DataFrame, n: int | Column) -> DataFrame:
    """``tokens`` (token, df) with idf among ``n`` streams."""
    return tokens.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)


def token_idf(streams: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """token, df, idf over the streams, or over those of each group ``by``."""
    if not by:
        return idf_of(token_frequency(streams), streams.count())
    size = streams.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return idf_of(token_frequency(streams, by).join(size, list(by)), F.col("n")).drop("n")


def _weighted_grams(rows: DataFrame, keys: list[str], idf: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """keys, gram, weight: distinct n-grams, with the mean weight of their tokens. ``idf``
    is joined once for each token of a gram: a small vocabulary is broadcast by its size."""
    grams = rows.select(*keys, F.explode(F.array_distinct(token_ngrams(F.col("tokens"), n))).alias("gram"))
    words, total = grams.withColumn("w", F.split("gram", " ")), F.lit(0.0)
    for k in range(n):
        words = words.withColumn("token", F.get("w", F.lit(k))).join(idf.select(*by, "token", F.col("idf").alias(f"idf{k}")), [*by, "token"], "left").drop("token")
        total = total + F.coalesce(f"idf{k}", F.lit(1.0))
    return words.select(*keys, "gram", (total / n).alias("weight"))


def gram_postings(streams: DataFrame, n: int = 2) -> DataFrame:
    """gram, media_id: the distinct n-grams of each stream. Best a library table."""
    return streams.select(F.explode(F.array_distinct(token_ngrams(F.col("tokens"), n))).alias("gram"), "media_id")


def gram_masses(streams: DataFrame, idf: DataFrame, n: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """by, media_id, wb: the summed weights of a stream's distinct n-grams. A gram weighs the mean
    of its tokens, so each token counts as often as distinct grams hold it; tokens are
    joined once, not grams. Frequent tokens, nearly all of a text, are summed where a stream
    lies, by weights that are broadcast; only rare ones are shuffled to theirs."""
    held = F.flatten(F.transform(F.array_distinct(token_ngrams(F.col("tokens"), n)), lambda g: F.split(g, " ")))
    each = streams.select(*by, "media_id", F.explode(held).alias("token"))
    own, key, idf = [*by, "media_id"], [*by, "token"], idf.select(*by, "token", "idf")
    frequent, rare = frequent_tokens(idf)
    known = each.join(F.broadcast(frequent), key, "left")
    if rare is None:
        return known.groupBy(*own).agg((F.sum(F.coalesce("idf", F.lit(1.0))) / n).alias("wb"))
    # Frequent tokens are one row of a stream, without a token, before anything is shuffled. Written,
    # as both branches would explode all streams.
    known = materialise(known.groupBy(*own, F.when(F.col("idf").isNull(), F.col("token")).alias("token")).agg(F.sum("idf").alias("w"), F.count(F.lit(1)).alias("k")))
    left = known.where(F.col("token").isNotNull()).join(rare, key, "left").select(*own, (F.col("k") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    return known.where(F.col("token").isNull()).select(*own, "w").unionByName(left).groupBy(*own).agg((F.sum("w") / n).alias("wb"))


def frequent_tokens(idf: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``idf``, best a written table, in two: the tokens of the least weights, ``FREQUENT`` at most,
    and all others, None if there are none. The driver learns how many tokens have each eighth of a weight."""
    level = F.floor(F.col("idf") * 8)
    cut, total = None, 0
    for row in sorted(idf.groupBy(level.alias("level")).count().collect()):
        total += row["count"]
        if total > FREQUENT:
            cut = row["level"]
            break
    return (idf, None) if cut is None else (idf.where(level < cut), idf.where(level >= cut))


def candidate_sets(pairs: DataFrame) -> DataFrame:
    """query_id, set: queries with the same candidates share a set, named by the least of them,
    so that what hangs on candidates is worked out once for each set. Sets are equal when
    their sizes and two sums of 64-bit hashes are."""
    told = lambda k: F.sum(F.xxhash64("media_id", F.lit(k)).cast("decimal(20,0)"))
    signed = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"), told(1).alias("a"), told(2).alias("b"))
    return materialise(signed.select("query_id", F.min("query_id").over(W.partitionBy("size", "a", "b")).alias("set")))


def _asked_grams(queries: DataFrame, idf: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, gram, weight), and (query_id, wa, query_count) of all queries."""
    words = materialise(queries.select(F.explode("tokens").alias("token")).distinct())
    grams = materialise(_weighted_grams(queries, ["query_id"], materialise(_among(idf, words, "token")), n))
    mass = grams.groupBy("query_id").agg(F.sum("weight").alias("wa"))
    size = queries.select("query_id", F.greatest(F.lit(1), F.size("tokens") - n + 1).cast("long").alias("query_count"))
    return grams, materialise(mass.join(size, "query_id"))


def _dice(shared: DataFrame, asked: DataFrame, masses: DataFrame) -> DataFrame:
    out = shared.join(asked, "query_id").join(masses, "media_id")
    return out.select("query_id", "media_id", F.least(F.lit(1.0), 2.0 * F.col("ws") / (F.col("wa") + F.col("wb"))).alias("confidence"), "match_count", "query_count")


def ngram_dice(queries: DataFrame, streams: DataFrame, n: int = 2, idf: DataFrame | None = None, pairs: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, media_id, confidence (weighted Dice), match_count, query_count. Only
    pairs that share an n-gram meet, through a join on the n-gram. ``idf`` and ``index``
    (``gram_postings``, ``gram_masses``) may come from a library. With ``pairs`` (query_id,
    media_id) each query meets its own candidates, which are also the documents of its idf."""
    if pairs is None:
        idf = materialise(token_idf(streams)) if idf is None else idf
        postings, masses = index or (gram_postings(streams, n), gram_masses(streams, idf, n))
        grams, asked = _asked_grams(queries, idf, n)
        shared = _among(postings, grams, "gram").join(grams, "gram").groupBy("query_id", "media_id").agg(F.sum("weight").alias("ws"), F.count(F.lit(1)).alias("match_count"))
        return _dice(shared, asked, masses)
    of = candidate_sets(pairs)
    held = pairs.join(of.where(F.col("query_id") == F.col("set")), "query_id").select("set", "media_id")
    streams = materialise(held.join(streams.select("media_id", "tokens"), "media_id"))
    queries = queries.join(of, "query_id")
    by, own = ("set",), ["set", "media_id"]
    idf = materialise(token_idf(streams, by))
    a = materialise(_weighted_grams(queries, ["query_id", "set"], idf, n, by))
    mass_a = a.groupBy("query_id").agg(F.sum("weight").alias("wa"))
    # A gram weighs the same on either side; only grams of queries have to be joined.
    b = streams.select(*own, F.explode(F.array_distinct(token_ngrams(F.col("tokens"), n))).alias("gram"))
    shared = b.join(a, [*by, "gram"]).groupBy("query_id", *own).agg(F.sum("weight").alias("ws"), F.count(F.lit(1)).alias("match_count"))
    size = queries.select("query_id", F.greatest(F.lit(1), F.size("tokens") - n + 1).cast("long").alias("query_count"))
    out = shared.join(mass_a, "query_id").join(gram_masses(streams, idf, n, by), own).join(size, "query_id")
    return out.select("query_id", "media_id", F.least(F.lit(1.0), 2.0 * F.col("ws") / (F.col("wa") + F.col("wb"))).alias("confidence"), "match_count", "query_count")


def ngram_stage(queries: DataFrame, streams: DataFrame, config: NgramConfig = NgramConfig(), top_n: int = 5, scope: DataFrame | None = None, idf: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Set matches of queries with enough tokens; nothing below the least similarity of
    the best, or for a query whose best two are closer than the margin. ``scope`` is that of
    ``fuzzy_stage``; ``idf`` and ``index`` are those of ``ngram_dice``."""
    asked = queries.where(F.size("tokens") >= max(config.n + 1, 4))
    streams = _met_by(asked, streams)
    idf = materialise(token_idf(streams)) if idf is None else idf
    if scope is None:
        ranked = top(ngram_dice(asked, streams, config.n, idf, index=index), top_n)
    else:
        pairs = scoped_pairs(asked, streams, scope)
        wide = top(ngram_dice(asked.join(pairs, "query_id", "left_anti"), streams, config.n, idf, index=index), top_n)
        ranked = top(ngram_dice(asked, streams, config.n, pairs=pairs), top_n).unionByName(wide)
    best = F.max("confidence").over(W.partitionBy("query_id"))
    return clear_winners(ranked.withColumn("best", best).where(F.col("best") >= config.min_similarity).drop("best"), config.min_margin)


def name_overlap(shared: Column, asked: Column, cap: float = 0.10) -> Column:
    """The bonus of shared names; 0 without names."""
    return F.when((shared > 0) & (asked > 0), F.least(F.lit(cap), cap * shared / asked)).otherwise(0.0)


def character_names(texts: DataFrame, key: str, text: str = "text", min_count: int = 1) -> DataFrame:
    """key, name, n: capitalised words that don't start a sentence."""
    from ..functions.text import NAME_STOPWORDS

    sentence = texts.select(key, F.explode(F.split(F.coalesce(text, F.lit("")), "[.!?]+")).alias("s"))
    words = sentence.select(key, F.posexplode(F.filter(F.split("s", r"\s+"), lambda w: w != "")).alias("i", "w"))
    name = F.lower(F.regexp_extract("w", r"^([A-Z][a-z]{2,})(?![\p{L}\p{N}\p{M}_])", 1))
    found = words.where(F.col("i") > 0).select(key, name.alias("name")).where((F.col("name") != "") & ~F.col("name").isin(*NAME_STOPWORDS))
    return found.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
