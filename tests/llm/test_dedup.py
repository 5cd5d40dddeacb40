import hashlib
from collections import Counter, defaultdict

import pytest
from helpers import WORDS, corpus, documents
from oracle import same
from pyspark.sql import functions as F

from lexitrace.llm import exact_dedup, ngram_join, substring_dedup


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# -- substring dedup --------------------------------------------------------------------


def substring_truth(rows, k=13):
    none = (1 << 63) - 1
    first = {}
    for i, t in rows:
        w = WORDS(t or "")
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, none), none if i is None else i)
    out = []
    for i, t in rows:
        w, gone = WORDS(t or ""), set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (none if i is None else i):
                gone |= set(range(p, p + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"hot_size": 0}, {"hot_size": 10, "bucket_size": 3}, {"largest": 4}, {"largest": 4, "slot_bits": 20}])
def test_substrings_equal_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 500)
    rows = corpus()
    got = substring_dedup.remove_repeats(documents(spark, rows, extra=True), **options).collect()
    want = substring_truth(rows)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(x[2] > 0 for x in want) > 10


def test_substrings_equal_their_sql(spark):
    same(spark, substring_dedup.op1_substring_dedup, substring_dedup.SQL)


def test_other_window_and_text(spark):
    rows = [(1, "a b c d"), (2, "x b c d y")]
    got = substring_dedup.remove_repeats(documents(spark, rows), k=3, m=1, with_text=True).collect()
    assert {r.doc_id: r.kept_text for r in got} == {1: "a b c d", 2: "x y"}


def test_no_documents(spark):
    empty = documents(spark, [])
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    assert ngram_join.jaccard_join(empty).count() == 0 and ngram_join.one_of_each_class(empty).count() == 0


# -- exact dedup ------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_equals_brute_force(spark, keep):
    rows = corpus()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], sha(t or "")) for i, t in rows)
    got = exact_dedup.exact_dedup(documents(spark, rows, extra=True), keep).collect()
    assert Counter(map(tuple, got)) == want
    stay = exact_dedup.drop_copies(documents(spark, rows, extra=True), keep)
    assert Counter((r.doc_id, r.text or "") for r in stay.collect()) == Counter((i, t) for t, i in best.items())
    assert stay.columns == documents(spark, rows, extra=True).columns


def test_index_grows_by_flushes(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.ExactDedupIndex(spark, path)
    a, b = documents(spark, [(5, "x"), (6, "y")]), documents(spark, [(2, "x"), (9, "z")])
    index.flush(a)
    assert {(r.min_id, r.n) for r in index.compact().collect()} == {(5, 1), (6, 1)}
    index.flush(b)
    again = exact_dedup.ExactDedupIndex(spark, path)
    new = documents(spark, [(20, "x"), (21, "new"), (22, None), (23, "x")])
    assert {r.doc_id: (r.known_id, r.known) for r in again.lookup(new).collect()} == {20: (2, 2), 21: (None, 0), 22: (None, 0), 23: (2, 2)}
    assert {(r.min_id, r.n) for r in again.compact().collect()} == {(2, 2), (6, 1), (9, 1)}
    assert {r.doc_id: r.keep_id for r in again.resolve(a.unionByName(b)).collect()} == {5: 2, 6: 6, 2: 2, 9: 9}


def test_levels_are_merged_when_they_are_full(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    for k in range(5):
        exact_dedup.ExactDedupIndex(spark, path, fan=2).flush(documents(spark, [(k, f"t{k % 2}"), (10 + k, f"u{k}")]))
    index = exact_dedup.ExactDedupIndex(spark, path, fan=2)
    assert [len(x) for x in index.state["levels"]] == [1, 0, 1] and len(index.state["log"]) == 5
    asked = documents(spark, [(50, "t0"), (51, "t1"), (52, "u4"), (53, "v")])
    assert {r.doc_id: (r.known_id, r.known) for r in index.lookup(asked).collect()} == {50: (0, 3), 51: (1, 2), 52: (14, 1), 53: (None, 0)}


def test_a_digest_of_two_texts_is_split(spark, monkeypatch):
    """All texts get one digest: the bytes tell them apart."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(7).cast("long"))
    monkeypatch.setattr(exact_dedup, "member_bitmaps", lambda df, c, bits=0: df)
    monkeypatch.setattr(exact_dedup, "may_contain", lambda df, c, bitmaps, keep=False, bits=0: df)
    monkeypatch.setattr(exact_dedup.ExactDedupIndex, "_filter", lambda *a: None)
    rows = [(1, "x"), (2, "y"), (3, "x"), (4, "z"), (5, "y"), (6, "x")]
    got = exact_dedup.exact_dedup(documents(spark, rows), "largest").collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {1: (6, 3, False), 3: (6, 3, False), 6: (6, 3, True), 2: (5, 2, False), 5: (5, 2, True), 4: (4, 1, True)}


def test_a_digest_alone_makes_nothing_known(spark, monkeypatch, tmp_path):
    """All texts get one digest: look-ups are told apart by the hash of the text."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(7).cast("long"))
    index = exact_dedup.ExactDedupIndex(spark, f"file://{tmp_path}/index", fan=2)
    for rows in ([(1, "x"), (2, "y")], [(3, "x")], [(4, "x")]):
        index.flush(documents(spark, rows))
    asked = documents(spark, [(9, "other text"), (10, "x"), (11, "y"), (12, None)])
    want = {9: (None, 0), 10: (1, 3), 11: (2, 1), 12: (None, 0)}
    assert {r.doc_id: (r.known_id, r.known) for r in index.lookup(asked).collect()} == want
    index.compact()
    assert {r.doc_id: (r.known_id, r.known) for r in index.lookup(asked).collect()} == want


def test_memtables_fill_a_level(spark, tmp_path):
    docs = documents(spark, [(k, f"t{k % 30}") for k in range(90)]).repartition(8)
    index = exact_dedup.ExactDedupIndex(spark, f"file://{tmp_path}/index")
    index.flush(docs, memtables=4)
    assert [len(x) for x in index.state["levels"]] == [0, 1] and len(index.state["log"]) == 4
    index.flush(documents(spark, [(100, "t1"), (101, "new")]), memtables=4)
    assert len(index.state["levels"][0]) >= 1 and set(index.state["bits"]) == {n for names in index.state["levels"] for n in names}
    got = {r.doc_id: (r.known_id, r.known) for r in index.lookup(documents(spark, [(1, "t1"), (2, "new"), (3, "?")])).collect()}
    assert got == {1: (1, 4), 2: (101, 1), 3: (None, 0)}


def test_filters_grow_with_their_members(spark):
    from lexitrace.llm import common

    assert [common.filter_bits(n) for n in (0, 1 << 16, 1 << 20, 50_000_000, 1 << 40)] == [1 << 20, 1 << 21, 1 << 25, 1 << 30, 1 << 30]
    members = spark.range(300_000).selectExpr("id * 7 AS x")
    bits = common.filter_bits(300_000)
    rows = spark.range(1_000_000).selectExpr("id AS x")
    passed = common.may_contain(rows, "x", common.member_bitmaps(members, "x", bits), bits=bits)
    n, hits = passed.count(), passed.where("x % 7 = 0").count()
    assert hits == 142_858 and n - hits < 0.08 * 1_000_000


def test_exact_equals_its_sql(spark):
    same(spark, exact_dedup.op2_exact_dedup, exact_dedup.SQL)


# -- Jaccard join -----------------------------------------------------------------------


def jaccard_truth(rows, n=5, t=0.8):
    sets = []
    for i, text in rows:
        w = WORDS(text or "")
        sets.append(frozenset(tuple(w[p : p + n]) for p in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else []))
    ids = [i for i, _ in rows]
    up = {i: i for i in ids if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if both >= t * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = top(ids[a]), top(ids[b])
                up[max(x, y)] = min(x, y)
    return Counter((i, None if i is None else top(i), k) for i, k in zip(ids, links))


@pytest.mark.parametrize("block", [2048, 4])
def test_join_equals_brute_force(spark, block, monkeypatch):
    known = corpus(seed=4)
    rows = known + [(known[0][0], known[8][1]), (known[20][0], "one more text of a known identifier"), (known[2][0], None)]
    assert len({i for i, _ in rows}) < len(rows) - 3  # some repeat an identifier
    monkeypatch.setattr(ngram_join, "VERIFY_BLOCK", block)
    monkeypatch.setattr(ngram_join, "CHUNK_WORDS", 100)
    monkeypatch.setattr(ngram_join.candidate_edges, "__defaults__", (0.8, block))
    got = ngram_join.jaccard_join(documents(spark, rows, extra=True)).collect()
    want = jaccard_truth(rows)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert sum(k > 5 for _, _, k in want) > 8


def test_rows_that_share_an_identifier(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(100)) for x in "abc")
    other = lambda t: t.replace("50 ", "50x ")
    big = (1 << 62) + 1
    rows = [(1, a), (1, b), (2, other(a)), (3, other(b)), (6, c), (6, other(c)), (5, f"{c} more"), (7, "x y z"), (7, "x y z"), (None, a), (big, "q r s t u v"), (big + 1, "q r s t u v")]
    got = ngram_join.jaccard_join(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == jaccard_truth(rows)
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, None: None, big: big, big + 1: big}
    assert {r.doc_id: r.n_links for r in got if r.doc_id in (3, 5)} == {3: 1, 5: 2}
    assert sorted(r.doc_id or 0 for r in ngram_join.one_of_each_class(documents(spark, rows, extra=True)).collect()) == [0, 1, 1, 5, 7, 7, big]


def test_join_equals_its_sql(spark):
    same(spark, ngram_join.op7_ngram_jaccard_join, ngram_join.SQL)


def test_recall_against_an_exact_join(spark):
    """Queries are the identifiers divisible by 20, against all rows: links found."""
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = {i: n for i, _, n in con.execute(ngram_join.SQL).fetchall() if i % 20 == 0}
    got = {r.doc_id: r.n_links for r in ngram_join.op7_ngram_jaccard_join(spark, sf).where("doc_id % 20 = 0").collect()}
    assert set(got) == set(want) and all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.999 * sum(want.values()) > 0


def test_scratch_is_shared_and_swept(spark, monkeypatch):
    from lexitrace.llm import common

    kept = common.materialise(spark.range(3))
    assert common.sweep(spark, 1) == 0 and kept.count() == 3
    gone = common.materialise(spark.range(3))
    common.discard(gone)
    assert kept.count() == 3

    class Conf:
        master = "yarn"

        def get(self, key, default=None):
            return {"spark.master": self.master}.get(key, default)

    class Session:
        conf = Conf()

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        Conf.master = master
        with pytest.raises(ValueError, match="share"):
            common.scratch_dir(Session())
    Conf.master = "local[4]"
    assert "lexitrace" in common.scratch_dir(Session())


def test_a_chain_is_one_class(spark):
    words = [f"v{k}" for k in range(120)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 90])) for k in range(5)]
    got = ngram_join.jaccard_join(documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == jaccard_truth(rows)
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {1, 2}
    assert [r.doc_id for r in ngram_join.one_of_each_class(documents(spark, rows, extra=True)).collect()] == [0]


def test_pruning_follows_the_posterior():
    from math import comb

    for n, least in ngram_join.least_matches(0.8, 1e-7):
        p = 0.8 + 0.2 / 256
        tail = lambda m: sum(comb(n + 1, i) * p**i * (1 - p) ** (n + 1 - i) for i in range(m + 1))
        assert tail(least - 1) < 1e-7 <= tail(least)


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 200), (300, 200)], "u long, v long")
    got = {r.node: r.label for r in ngram_join.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 200: 100, 300: 100}
    assert ngram_join.components(edges.where(F.col("u") < 0)).count() == 0
