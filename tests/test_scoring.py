import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexitrace.config import FuzzyConfig, NgramConfig
from lexitrace.operators import fingerprint as FP
from lexitrace.operators import scoring as S
from lexitrace.operators import verdict as V


def test_shingles(spark):
    at = lambda words, k: spark.range(1).select(FP.shingles(F.array(*map(F.lit, words)).cast("array<string>"), k)).first()[0]
    assert at("abc", 2) == ["a b", "b c"]
    assert at("ab", 3) == [] and at("", 1) == [] and at("abc", 0) == []


def test_hash(spark):
    import hashlib

    got = spark.range(1).select(FP.hash_shingle(F.lit("a b c")), FP.hash_shingle(F.lit("x"), "sha256", 8)).first()
    assert got[0] == hashlib.md5(b"a b c").hexdigest()[:16] and got[1] == hashlib.sha256(b"x").hexdigest()[:8]


def test_time_weight(spark):
    w = [spark.range(1).select(FP.time_weight(F.lit(x))).first()[0] for x in (0.0, 0.2, 0.5, 0.8, 1.0, 0.1)]
    assert [round(x, 6) for x in w] == [0.6, 1.0, 1.0, 1.0, 0.6, 0.8]


def two_pointers(ts, span):
    best, at, lo = 1, None, 0
    for hi in range(len(ts)):
        while ts[hi] - ts[lo] > span:
            lo += 1
        if hi - lo + 1 > best:
            best, at = hi - lo + 1, (ts[lo], ts[hi])
    return best, at


def longest_run(ts, gap):
    best = run = 1
    for a, b in zip(ts, ts[1:]):
        run = run + 1 if b - a <= gap else 1
        best = max(best, run)
    return best


def test_clusters_and_runs_equal_loops(spark):
    rng = random.Random(3)
    groups = {g: sorted(rng.choices(range(0, 200_000, 500), k=rng.randint(1, 40))) for g in range(60)}
    hits = spark.createDataFrame([(g, t) for g, ts in groups.items() for t in ts] + [(1, None)], "g int, start_ms long")
    for stretch in (1, 64):
        runs = {r.g: r.run for r in S.longest_runs(hits, ["g"], stretch=stretch).collect()}
        found = S.clusters(hits, ["g"], stretch=stretch).collect()
        assert len(found) == len(runs) == 60
        for r in found:
            best, at = two_pointers(groups[r.g], 30_000)
            assert (r.best, (r.win_start, r.win_end)) == (best, at or (None, None))
            assert runs[r.g] == longest_run(groups[r.g], 4_000)


def test_a_hot_group_is_dealt_out(spark):
    """One group holds all hits, some at one time, over many stretches."""
    rng = random.Random(4)
    times = sorted(rng.choices(range(-5_000_000, 20_000_000, 700), k=6000) + [77_000] * 500)
    hits = spark.createDataFrame([(1, t) for t in times], "g int, start_ms long")
    assert S._ticks(hits, ["g"], "start_ms", 64 * 4_000).select("part").distinct().count() > 90
    found = S.clusters(hits, ["g"], stretch=2).first()
    best, at = two_pointers(times, 30_000)
    assert (found.best, (found.win_start, found.win_end)) == (best, at)
    assert S.longest_runs(hits, ["g"], stretch=2).first().run == longest_run(times, 4_000)


def test_titles_are_compared_once_where_they_may_be_close(spark):
    from difflib import SequenceMatcher

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde ") for _ in range(rng.randrange(9)))
    pairs = [(word(), word()) for _ in range(400)] + [("same title", "same title")] * 50 + [("a", None), (None, None)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.ratio for r in V.title_ratios(rows, "a", "b").collect()}
    for a, b in set(pairs):
        exact = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        assert got.get((a, b), exact if exact < V.CLOSE else -1.0) == exact
    assert len(got) < 300


def test_run_bonus(spark):
    at = lambda n: spark.range(1).select(S.run_bonus(F.lit(n).cast("long"))).first()[0]
    assert at(None) == at(1) == 0.0 and 0 < at(3) < at(12) <= 0.20


@given(st.lists(st.integers(0, 9), max_size=30))
def test_lis_equals_dynamic_programming(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    assert S.lis_length(values) == max(best, default=0)


def test_lis_fold_equals_bisection(spark):
    rng = random.Random(5)
    lists = [[rng.randint(0, 12) for _ in range(rng.randint(0, 15))] for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, p array<int>")
    assert {r.k: r.n for r in df.select("k", S.lis_fold(F.col("p")).alias("n")).collect()} == {k: S.lis_length(p) for k, p in enumerate(lists)}


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=200)
def test_alignment_is_the_longest_common_subsequence(q, r):
    t = [[0] * (len(r) + 1) for _ in range(len(q) + 1)]
    for i, a in enumerate(q):
        for j, b in enumerate(r):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    assert S.alignment(q, r)[0] == t[-1][-1]


STREAMS = [(1, "the judge entered the court and the trial began at nine".split()), (2, "a ship sailed from the harbour in the fog at nine".split()), (3, [])]


def streams(spark):
    return spark.createDataFrame([(m, t, [1000 * k for k in range(len(t))]) for m, t in STREAMS], "media_id long, tokens array<string>, starts array<long>")


def asked(spark, *texts):
    return spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)], "query_id long, tokens array<string>")


def test_fuzzy_stage(spark):
    q = asked(spark, "the judge came in the court um and trial began at nine", "too short", "fish bread oil salt water fire smoke wood stone")
    got = S.fuzzy_stage(q, streams(spark)).collect()
    assert [(r.query_id, r.media_id, r["rank"]) for r in got] == [(0, 1, 1)]
    assert got[0].confidence >= 0.45 and got[0].win_start == 0
    assert S.lcs_scores(q, streams(spark), block=1).count() == S.lcs_scores(q, streams(spark)).count()
    assert S.fuzzy_stage(q.limit(0), streams(spark)).count() == 0


def test_fuzzy_margin_rejects_a_tie(spark):
    double = streams(spark).unionByName(streams(spark).withColumn("media_id", F.col("media_id") + 10))
    assert S.fuzzy_stage(asked(spark, "the judge entered the court and the trial began"), double, FuzzyConfig()).count() == 0


def test_dice_bounds_and_values(spark):
    got = {(r.query_id, r.media_id): r.confidence for r in S.ngram_dice(asked(spark, " ".join(STREAMS[0][1]), "x y z w"), streams(spark)).collect()}
    assert round(got[(0, 1)], 9) == 1.0 and (1, 1) not in got and all(0 < x <= 1 for x in got.values())
    assert [r.media_id for r in S.ngram_stage(asked(spark, " ".join(STREAMS[0][1])), streams(spark), NgramConfig()).where("rank = 1").collect()] == [1]


def test_idf(spark):
    s = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c"])], "media_id long, tokens array<string>")
    got = {r.token: (r.df, round(r.idf, 9)) for r in S.token_idf(s).collect()}
    assert got == {"a": (2, 1.0), "b": (1, round(math.log(1.5) + 1, 9)), "c": (1, round(math.log(1.5) + 1, 9))}
    df = spark.createDataFrame([("x", 1), ("y", 900)], "hash string, df long")
    assert S.idf_factors(df, 2).count() == 0
    f = {r.hash: r.factor for r in S.idf_factors(df, 1000).collect()}
    assert f["x"] > 1 > f["y"] >= 0.35 and f["x"] <= 3
    q = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.6)], "query_id long, hash string, weight double")
    w = S.apply_idf(q, spark.createDataFrame([("a", 2.0)], "hash string, factor double"))
    assert {r.hash: r.weight for r in w.collect()} == {"a": 2.0, "b": 0.6}


def test_names(spark):
    t = spark.createDataFrame([(1, "Hello Lanterns. The judge saw Tyler and Tyler! Then Conrad"), (2, None)], "k int, text string")
    assert Counter({r.name: r.n for r in S.character_names(t, "k").collect()}) == Counter({"lanterns": 1, "tyler": 2, "conrad": 1})
    at = lambda a, b: spark.range(1).select(S.name_overlap(F.lit(a), F.lit(b))).first()[0]
    assert (at(2, 2), at(0, 2), at(0, 0), at(1, 2)) == (0.10, 0.0, 0.0, 0.05)


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id long, media_id long, confidence double, match_count long, rank int, duration_s double, n_words int, duration_seconds int, n_tokens int, show_title string, episode_title string, expected_show string, query_title string")


def test_boosts(spark):
    rows = [(1, 1, 0.40, 9, 1, 0.0, 0, None, 0, "Other", "A", "Lanterns", "Judge"), (1, 2, 0.38, 9, 2, 0.0, 0, None, 0, "Lanterns (1986)", "The Judge", "Lanterns", "The Judge"), (2, 3, 0.95, 1, 1, 0.0, 0, None, 0, "Lanterns", None, "lanterns", None)]
    got = {r.media_id: (round(r.confidence, 6), r["rank"], r.boost_notes) for r in V.metadata_boosts(candidates(spark, rows)).collect()}
    assert got[1][:2] == (0.40, 2) and got[2] == (0.63, 1, "show match +15%, episode title +10%") and got[3][0] == 1.0


def test_tie_breaks(spark):
    base = dict(n=None, s=None)
    row = lambda q, m, c, k, d, t: (q, m, c, 9, k, 100.0, 200, d, t, "s", "e", "s", "e")
    rows = [
        row(1, 1, 0.50, 1, 200, 0), row(1, 2, 0.48, 2, 101, 0),  # the second is closer in length
        row(2, 1, 0.50, 1, 100, 0), row(2, 2, 0.30, 2, 100, 0),  # not near
        row(3, 1, 0.50, 1, None, 0), row(3, 2, 0.48, 2, 100, 0),  # only the second is known
        row(4, 1, 0.50, 1, 100, 10), row(4, 2, 0.49, 2, 100, 200),  # density decides
        row(5, 1, 0.50, 1, 90, 0),
    ]
    got = {r.query_id: r.media_id for r in V.tie_breaks(candidates(spark, rows)).where("rank = 1").collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 2, 5: 1} and base


def guess(spark, rows):
    return spark.createDataFrame(rows, "query_id long, media_id long, confidence double, match_count long, margin double")


def test_cascade(spark):
    exact = guess(spark, [(1, 1, 0.9, 9, 0.5), (2, 1, 0.2, 1, 0.1), (4, 1, 0.3, 1, None)])
    fuzzy = guess(spark, [(1, 5, 1.0, 9, 0.2), (3, 6, 0.6, 9, 0.2)])
    ngram = guess(spark, [(2, 7, 0.5, 3, None), (3, 8, 0.9, 3, 0.2), (4, 9, 0.3, 3, 0.2), (5, 9, 0.25, 3, 0.1)])
    noted = lambda df, note: df.withColumn("boost_notes", F.lit(note))
    # Boosts don't count where a guess is to be replaced.
    late = noted(ngram, "c").withColumn("raw", F.when(F.col("query_id") == 4, 0.2).otherwise(F.col("confidence")))
    found = V.cascade(noted(exact, "a"), noted(fuzzy, ""), late).collect()
    got = {r.query_id: (r.media_id, r.method, r.margin) for r in found}
    assert {r.query_id: (r.early_notes, r.boost_notes) for r in found} == {1: (None, "a"), 2: ("a", "c"), 3: (None, ""), 4: (None, "a"), 5: (None, "c")}
    assert got == {1: (1, "phonetic", 0.5), 2: (7, "ngram", 0.1), 3: (6, "fuzzy", None), 4: (1, "phonetic", None), 5: (9, "ngram", 0.1)}


FILES = "query_id long, filename string, duration_s double, file_season int, file_episode int"
LEAD = "query_id long, media_id long, confidence double, match_count long, margin double, method string, boost_notes string, media_title string, show_title string, episode_title string, season int, episode int, duration_seconds int, duration_source string"


def test_verdicts(spark):
    files = spark.createDataFrame([(1, "X.S01E02.mkv", 3600.0, 1, 2), (2, "y.mkv", 3600.0, None, None), (3, "z.mkv", 3600.0, None, None), (4, "w.mkv", 3600.0, 9, 9), (5, "v.mkv", 3600.0, None, None)], FILES)
    lead = spark.createDataFrame(
        [
            (1, 1, 0.8, 20, 0.5, "phonetic", "", "T", "X", "Name", 1, 2, 3600, "manual"),
            (2, 2, 0.30, 9, 0.5, "phonetic", "", "T", None, None, 1, 3, 1800, "tvmaze"),
            (4, 4, 0.8, 20, 0.01, "phonetic", "", "T", "X", "N", 1, 4, 3600, "subtitle"),
            (5, 5, 0.29, 9, None, "ngram", "show match +15%", "T", "X", "N", 1, 5, 1800, "subtitle"),
        ],
        LEAD,
    )
    got = {r.query_id: r for r in V.verdicts(files, lead, runtimes=spark.createDataFrame([("s01e02", 30.0)], "episode_id string, minutes double")).collect()}
    assert (got[1].name_status, got[1].needs_review, got[1].suggested_filename) == ("correct", False, "X - S01E02 - Name.mkv")
    assert got[1].notes == "runtime 60m vs expected 30.0m"
    assert got[2].name_status == "rename" and not got[2].needs_review and "length differs: file is 60m vs listed ~30m (100% off)" in got[2].notes
    assert (got[3].name_status, got[3].needs_review, got[3].notes, got[3].suggested_filename) == ("unknown", True, "no match", "")
    assert got[4].needs_review and got[4].name_status == "unknown" and "ambiguous: runner-up within 1%" in got[4].notes
    assert not got[5].needs_review and got[5].notes.startswith("show match +15%; matched via n-gram fallback; approx duration off")
    results = V.verdicts(files, lead)
    assert {r.bucket: r.n for r in V.status_counts(results).collect()} == {"All": 5, "Rename": 2, "Correct": 1, "Review": 2}
    assert tuple(V.summary(results).first()) == (5, 3, 1, 2, 2)
    assert V.rename_plan(results).count() == 4
    assert [r.query_id for r in V.find_results(results, " NAME ", "Correct").collect()] == [1]
    assert [r.query_id for r in V.sort_results(results, "season").collect()][0] == 3


def test_title_mismatch(spark):
    at = lambda f, t: spark.range(1).select(V.title_mismatch(F.lit(f), F.lit(t))).first()[0]
    assert at("X.S01E02.The Judge (1).mkv", "Other") and not at("X.S01E02.mkv", "Other") and not at("X - S01E02 - The Judge Part 1.mkv", "The Judge (1)")
