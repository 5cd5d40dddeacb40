"""Ordered matching by an inverted index and bit-parallel alignment, against plain loops."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexitrace.config import FuzzyConfig
from lexitrace.operators import bitlcs
from lexitrace.operators import scoring as S


def masks_of(query, reference):
    words = range(len(query) // 64 + 1)
    rows = [[sum(1 << (i % 64) for i, t in enumerate(query) if t == r and i // 64 == w) for w in words] for r in reference if r in query]
    return np.array(rows, np.uint64).reshape(len(rows), len(query) // 64 + 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 12), min_size=1, max_size=150), st.lists(st.integers(0, 14), max_size=60)), min_size=1, max_size=6))
def test_lengths_equal_bisection(pairs):
    for q, r in pairs:
        m = masks_of(q, r)
        if len(m):
            assert bitlcs.lengths(m, np.array([len(m)]), np.array([len(q)]))[0] == S.alignment(q, r)[0]
    narrow = [(q[:60], r) for q, r in pairs]
    made = [masks_of(q, r) for q, r in narrow]
    kept = [(m, q, r) for m, (q, r) in zip(made, narrow) if len(m)]
    if kept:
        found = bitlcs.lengths(np.concatenate([m for m, _, _ in kept]), np.array([len(m) for m, _, _ in kept]), np.array([len(q) for _, q, _ in kept]))
        assert found.tolist() == [S.alignment(q, r)[0] for _, q, r in kept]


def loops(queries, streams, top_n=5):
    out = {}
    for i, q in queries:
        rows = []
        for m, tokens, starts in streams:
            n, a, b = S.alignment(q, tokens)
            if n:
                rows.append((-round(n / len(q), 9), -n, m, n, starts[a], starts[b]))
        out[i] = [(m, n, len(q), a, b) for _, _, m, n, a, b in sorted(rows)[:top_n]]
    return {i: r for i, r in out.items() if r}


def tables(spark, queries, streams):
    return spark.createDataFrame(queries, "query_id long, tokens array<string>").repartition(3), spark.createDataFrame(streams, "media_id long, tokens array<string>, starts array<long>").repartition(5)


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.media_id, r.match_count, r.query_count, r.win_start, r.win_end))
    return out


def zipf(rng, n, size=400):
    return [f"t{min(int(rng.paretovariate(0.7)) - 1, size)}" for _ in range(n)]


def world(seed, n_streams=60, n_queries=40):
    rng = random.Random(seed)
    streams = [(m, zipf(rng, rng.choice([1, 5, 40, 300]))) for m in range(n_streams)]
    streams += [(n_streams + 1, streams[3][1]), (n_streams + 2, ["t0"] * 500)]
    streams = [(m, t, [3 * k for k in range(len(t))]) for m, t in streams]
    queries = [(k, zipf(rng, rng.choice([1, 3, 20, 70, 200]))) for k in range(n_queries)]
    for k in range(0, n_queries, 3):
        source = rng.choice(streams)[1]
        queries[k] = (k, [t for t in source if rng.random() < 0.8] or ["t0"])
    return queries + [(1000, ["nowhere"]), (1001, []), (1002, ["t0"] * 90)], streams


def test_top_matches_equal_loops(spark):
    queries, streams = world(1)
    q, s = tables(spark, queries, streams)
    want = loops([x for x in queries if x[1]], streams)
    for options in ({}, {"block": 1}, {"postings": S.token_postings(s)}):
        assert ranked(S.lcs_scores(q, s, **options).collect()) == want
    assert ranked(S.lcs_scores(q, s, top_n=2).collect()) == loops([x for x in queries if x[1]], streams, 2)


def test_small_expansions_equal_loops(spark, monkeypatch):
    queries, streams = world(2)
    shape = pa.struct([("query_id", pa.int64()), ("tokens", pa.list_(pa.string())), ("least", pa.int64())])
    asked = [{"query_id": i, "tokens": t, "least": 1} for i, t in queries]
    batch = pa.RecordBatch.from_arrays([pa.array([m for m, _, _ in streams]), pa.array([t for _, t, _ in streams], pa.list_(pa.string())), pa.array([x for _, _, x in streams], pa.list_(pa.int64())), pa.array([asked] * len(streams), pa.list_(shape))], ["media_id", "tokens", "starts", "asked"])
    monkeypatch.setattr(bitlcs, "EXPANDED", 50)
    monkeypatch.setattr(bitlcs, "HELD", 500)
    got = {(r["query_id"], r["media_id"]): r["match_count"] for b in bitlcs.aligned(iter([batch])) for r in b.to_pylist()}
    want = {(i, m): n for i, q in queries for m, t, _ in streams if (n := S.alignment(q, t)[0])}
    assert got == want


def test_stage_and_scope_equal_loops(spark):
    queries, streams = world(3)
    q, s = tables(spark, queries, streams)
    config = FuzzyConfig()

    def stage(rows):
        out = {}
        for i, found in rows.items():
            found = [x for x in found if x[1] / x[2] >= config.min_lcs_ratio and x[2] >= config.min_query_tokens]
            if found and (len(found) == 1 or found[0][1] / found[0][2] - found[1][1] / found[1][2] >= config.min_margin):
                out[i] = found
        return out

    want = stage(loops([x for x in queries if x[1]], streams))
    assert ranked(S.fuzzy_stage(q, s).collect()) == want and want
    scope = spark.createDataFrame([(k, m) for k in range(0, 40, 2) for m in range(0, 62, 3)] + [(4, 999)], "query_id long, media_id long")
    limited = stage(loops([x for x in queries if x[1] and x[0] < 40 and x[0] % 2 == 0], [x for x in streams if x[0] % 3 == 0]) | loops([x for x in queries if x[1] and (x[0] >= 40 or x[0] % 2)], streams))
    assert ranked(S.fuzzy_stage(q, s, scope=scope).collect()) == limited


def test_ten_thousand_queries(spark):
    """Each finds the stream that it was cut from, in joins and one pass of alignments."""
    rng = random.Random(8)
    streams = [(m, [f"w{rng.randrange(3000)}" if rng.random() < 0.7 else f"c{rng.randrange(8)}" for _ in range(120)]) for m in range(500)]
    queries = []
    for k in range(10_000):
        m, t = rng.choice(streams)
        at = rng.randrange(90)
        queries.append((k, [x for x in t[at : at + 30] if rng.random() < 0.9], m))
    q, s = tables(spark, [(k, t) for k, t, _ in queries], [(m, t, list(range(120))) for m, t in streams])
    got = {r.query_id: (r.media_id, r.match_count) for r in S.lcs_scores(q, s, top_n=1).collect()}
    assert len(got) == 10_000
    best = [got[k][0] == m and got[k][1] == len(t) for k, t, m in queries]
    assert sum(best) > 9_990


def test_only_promising_pairs_are_aligned(spark):
    """Common tokens make no candidates when a rare part of the query must be shared."""
    rng = random.Random(9)
    streams = [(m, [f"w{m}x{k}" if k % 2 else f"c{rng.randrange(5)}" for k in range(60)]) for m in range(300)]
    queries = [(m, t[10:40]) for m, t in streams[:20]]
    q, s = tables(spark, queries, [(m, t, list(range(60))) for m, t in streams])
    postings = S.token_postings(s)
    tokens = S._asked_tokens(q, postings.groupBy("token").count().withColumnRenamed("count", "df"))
    least = q.selectExpr("query_id", "20L AS least")
    found = S.ordered_candidates(tokens, least, postings).collect()
    assert sorted((r.query_id, r.media_id) for r in found) == [(m, m) for m in range(20)]
