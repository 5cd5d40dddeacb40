"""What queries over the documents may write and shuffle."""

import pytest
from oracle import SF, same
from pyspark.sql import functions as F

from lexitrace.operators import fingerprint as FP
from lexitrace.operators import library as L
from lexitrace.operators import scoring as S
from lexitrace.plans import ingest, queries  # noqa: F401
from lexitrace.sources import subtitles as SRC
from lexitrace.sources import tables
from lexitrace.sources.scratch import materialise


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["library_fingerprints", "media_fingerprint_counts", "library_listing", "scoped_count", "unprocessed_sources", "media_hashes", "weighted_coverage", "hash_lookup", "hash_document_frequency", "exact_match_topk"])
def test_fingerprints_are_never_written(spark, name):
    before = dict(queries._BUILT)
    queries._BUILT.clear()
    queries.QUERIES[name](spark, SF).count()
    assert not {key[3] for key in queries._BUILT} & {"fingerprints", "hash_df"}
    queries._BUILT.update(before)


def test_fingerprints_are_counted_where_their_document_lies(spark):
    for name in ("library_fingerprints", "media_fingerprint_counts"):
        text = plan(queries.QUERIES[name](spark, SF))
        assert text.count("Exchange ") == text.count("Exchange hashpartitioning(doc_id") == 1


def test_packed_hashes_come_back(spark):
    hashes = ["0000000000000000", "000000000000000a", "7fffffffffffffff", "8000000000000000", "ffffffffffffffff", "0123456789abcdef"]
    df = spark.createDataFrame([(h,) for h in hashes], "hash string").select("hash", FP.packed(F.col("hash")).alias("n"))
    assert [(r.hash, r.back) for r in df.select("hash", FP.unpacked(F.col("n")).alias("back")).collect()] == [(h, h) for h in hashes]
    assert len({r.n for r in df.collect()}) == len(hashes)


def test_frequencies_count_a_media_once_over_rows_and_parts(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 2), ("c", 3), ("c", 4), ("c", 5)]
    prints = spark.createDataFrame(rows, "hash string, media_id long")
    want = {"a": 2, "b": 1, "c": 3}
    for df in (L.document_frequency(prints), L.document_frequency(prints.repartition(3), 7), L.document_frequency(prints.repartition(3, "media_id"), 2)):
        assert {r.hash: r.df for r in df.collect()} == want


def test_factors_of_some_hashes_equal_those_of_all(spark):
    df = spark.createDataFrame([("a", 1), ("b", 50), ("c", 999), ("d", 1)], "hash string, df long")
    some = S.idf_factors(df.where("hash < 'c'"), 1000, S.idf_mean(df, 1000))
    whole = {r.hash: round(r.factor, 9) for r in S.idf_factors(df, 1000).collect()}
    assert {r.hash: round(r.factor, 9) for r in some.collect()} == {h: whole[h] for h in "ab"}


def test_equal_candidates_are_one_set(spark):
    pairs = spark.createDataFrame([(q, m) for q in (1, 2, 3) for m in range(5)] + [(4, m) for m in range(4)] + [(5, 0)], "query_id long, media_id long")
    assert {r.query_id: r.set for r in S.candidate_sets(pairs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_sets_of_candidates_have_weights_of_their_own(spark):
    """One query's result is the same by itself as beside queries with other candidates."""
    streams = spark.createDataFrame([(m, [f"w{(m * k) % 7}" for k in range(9)], list(range(9))) for m in range(1, 9)], "media_id long, tokens array<string>, starts array<long>")
    queries = spark.createDataFrame([(q, [f"w{(q * k) % 7}" for k in range(5)]) for q in (1, 2, 3)], "query_id long, tokens array<string>")
    pairs = spark.createDataFrame([(1, m) for m in range(1, 9)] + [(2, m) for m in range(1, 9)] + [(3, m) for m in (2, 3, 5)], "query_id long, media_id long")
    rows = lambda df: sorted((r.query_id, r.media_id, round(r.confidence, 9), r.match_count) for r in df.collect())
    alone = [x for q in (1, 2, 3) for x in rows(S.ngram_dice(queries.where(f"query_id = {q}"), streams, pairs=pairs.where(f"query_id = {q}")))]
    assert rows(S.ngram_dice(queries, streams, pairs=pairs)) == alone and alone


def test_scoped_pairs_below_the_floor_are_not_aligned(spark, monkeypatch):
    seen, aligned = [], S.aligned_pairs
    monkeypatch.setattr(S, "aligned_pairs", lambda pairs, *a: seen.append(pairs.count()) or aligned(pairs, *a))
    streams = spark.createDataFrame([(m, ["common"] + [f"w{m}x{k}" for k in range(9)], list(range(10))) for m in range(20)], "media_id long, tokens array<string>, starts array<long>")
    queries = streams.where("media_id < 2").selectExpr("media_id AS query_id", "tokens")
    pairs = queries.select("query_id").crossJoin(streams.select("media_id"))
    got = S.pair_lcs_scores(pairs, queries, streams, floor=0.45).collect()
    assert [(r.query_id, r.media_id) for r in sorted(got)] == [(0, 0), (1, 1)] and seen == [2]


def test_hashes_of_factors_are_shuffled_once_and_not_written(spark):
    before = dict(queries._BUILT)
    queries._BUILT.clear()
    df = queries.QUERIES["hash_idf_factors"](spark, SF)
    assert df.collect() and not {key[3] for key in queries._BUILT} & {"fingerprints", "hash_df"}
    assert "ReusedExchange" in plan(df)
    queries._BUILT.update(before)


def test_texts_dealt_by_their_key_are_not_shuffled_to_tell_their_language(spark):
    df = queries.QUERIES["detected_languages"](spark, SF)
    df.collect()
    dealt = [line for line in plan(df).split("== Initial Plan")[0].splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert not [line for line in dealt if "word" in line]


@pytest.fixture
def unbroadcast(spark):
    """The planner broadcasts nothing by its size, as with tables that are large."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_streams_of_documents_that_lie_whole_are_not_shuffled(spark):
    texts = ["one two three\n\nfour five", "", None, "\n \n", "[noise]\nBOB: hello there", "same line\nsame line", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists = FP.cue_lists(SRC.documents_as_lists(docs))
    whole = FP.whole_streams(lists)
    want = FP.token_streams(FP.cue_tokens(SRC.documents_as_cues(docs)))
    rows = lambda df: sorted((r.media_id, r.tokens, r.starts) for r in df.collect())
    assert rows(whole) == rows(want) and len(rows(want)) == 3
    assert whole.schema.simpleString() == want.schema.simpleString()
    assert "Exchange" in plan(want) and "Exchange" not in plan(whole)
    told = lambda df: sorted((r.media_id, r.start_ms, r.end_ms, r.tokens) for r in df.collect() if r.tokens)
    assert told(SRC.lists_as_cues(lists)) == told(FP.cue_tokens(SRC.documents_as_cues(docs)))


def test_asked_fingerprints_are_those_of_all_that_are_asked_for(spark):
    cues = spark.createDataFrame([(m, 0, 9, [f"w{(m * k) % 5}" for k in range(m + 2)]) for m in range(8)] + [(9, 0, 9, None)], "media_id long, start_ms long, end_ms long, tokens array<string>")
    among = spark.createDataFrame([(x,) for x in ("w0 w1 w2 w3", "w0 w0 w0", "w0 w3 w1 w4 w2", "w2 w4", "w9 w9 w9")], "shingle string")
    hashes = {r[0] for r in among.select(FP.hash_shingle(F.col("shingle"))).collect()}
    got, whole = (sorted(df.collect()) for df in (FP.library_fingerprints(cues, among=among), FP.library_fingerprints(cues)))
    assert got == [r for r in whole if r.hash in hashes] and {r.shingle_size for r in got} == {3, 4, 5}


def test_masses_shuffle_rare_tokens_only(spark, unbroadcast, monkeypatch):
    streams = spark.createDataFrame([(m, ["the", "of", f"w{m % 3}", "the", f"x{m}", "of", "the"]) for m in range(9)] + [(9, ["the"])], "media_id long, tokens array<string>")
    idf = materialise(S.token_idf(streams).where("token != 'x0'"))
    rows = lambda df: {r.media_id: round(r.wb, 9) for r in df.collect()}
    whole = S.gram_masses(streams, idf)
    known = {r.token: r.idf for r in idf.collect()}
    grams = {r.media_id: {w for w in zip(r.tokens, r.tokens[1:])} for r in streams.collect()}
    assert rows(whole) == {m: round(sum(known.get(w, 1.0) for g in held for w in g) / 2, 9) for m, held in grams.items() if held}
    assert "BroadcastHashJoin [token" in plan(whole) and "Exchange hashpartitioning(token" not in plan(whole)
    monkeypatch.setattr(S, "FREQUENT", 5)
    frequent, rare = S.frequent_tokens(idf)
    assert {r.token for r in frequent.collect()} == {"the", "of", "w0", "w1", "w2"} and rare.count() == 8
    assert rows(S.gram_masses(streams, idf)) == rows(whole)


def test_only_streams_of_pairs_travel_to_be_aligned(spark, unbroadcast):
    streams = spark.createDataFrame([(m, [f"w{m}x{k}" for k in range(9)], list(range(9))) for m in range(20)], "media_id long, tokens array<string>, starts array<long>")
    queries = streams.where("media_id < 2").selectExpr("media_id AS query_id", "tokens")
    pairs = queries.selectExpr("query_id", "query_id AS media_id", "1 AS least")
    got = S.aligned_pairs(pairs, queries, streams)
    assert sorted((r.query_id, r.media_id, r.match_count) for r in got.collect()) == [(0, 0, 9), (1, 1, 9)]
    assert "BroadcastHashJoin [media_id" in plan(got) and "LeftSemi" in plan(got)


def test_no_queries_read_no_stream(spark):
    streams = spark.createDataFrame([(m, [f"w{k}" for k in range(m, m + 9)], list(range(9))) for m in range(5)], "media_id long, tokens array<string>, starts array<long>")
    none = streams.where("media_id < 0").selectExpr("media_id AS query_id", "tokens")
    idf = S.token_idf(streams)
    found = S.ngram_stage(none, streams, idf=idf)
    assert found.count() == 0 and S.fuzzy_stage(none, streams).count() == 0
    assert "explode(flatten" not in plan(found)  # no masses


def test_batch_over_tables_that_lie_whole_equals_its_sql(spark, monkeypatch):
    before = dict(queries._BUILT)
    queries._BUILT.clear()
    monkeypatch.setattr(tables, "SMALL", 0)
    monkeypatch.setattr(S, "FREQUENT", 50)
    same(spark, queries.QUERIES["identify_batch"], queries.SQL["identify_batch"])
    queries._BUILT.clear()
    queries._BUILT.update(before)
