import math
from collections import defaultdict

import numpy as np
import pytest
from oracle import SF

from lexitrace.llm import whitening

SHAPE = "vec_id long, embedding array<float>, k string, v string, n string"


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, e, "x", "y", "z") for i, e in rows], SHAPE.replace("float", kind))


def truth(rows, d):
    """n, whole vectors, sums, covariance, exact, from plain Python numbers."""
    good = [(i, e) for i, e in rows if e is not None and len(e) == d and all(c is not None and math.isfinite(c) for c in e)]
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in e] for _, e in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    return [i for i, _ in good], x, n, sums


def check(found, rows, d, k):
    ids, x, n, sums = truth(rows, d)
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    by = defaultdict(list)
    for r in found:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, got in by.items():
        want = centred @ axes[:, c - 1] / math.sqrt(values[c - 1])
        pairs = sorted((r.vec_id, int(r.deviation), r.whitened) for r in got)
        mine = sorted(zip(ids, deviation, want))
        assert [p[:2] for p in pairs] == [m[:2] for m in mine]
        a, b = np.array([p[2] for p in pairs]), np.array([m[2] for m in mine])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert all(r.n == n and abs(r.explained - values[c - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-8 for r in got)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(7, 7))
    rows = [(k, [float(v) for v in (rng.normal(size=7) @ mix + 3).astype(np.float32)]) for k in range(300)]
    rows += [(1000, None), (1001, [None] * 7), (1002, [float("nan")] * 7), (1003, [1.0] * 6 + [float("inf")]), (1004, [1.0]), (5, [2.0] * 7), (None, [0.5] * 7)]
    df = vectors(spark, rows).repartition(5)
    found = whitening.whiten(df, components=4).collect()
    kept = [r for r in rows if r[0] is not None]
    none = [r for r in found if r.vec_id is None]
    assert len(none) == 4 and len(found) == 4 * 302
    as_zero = [r if r.vec_id is not None else r.asDict() | {"vec_id": -1} for r in found]
    from pyspark.sql import Row

    check([r if isinstance(r, Row) else Row(**r) for r in as_zero], kept + [(-1, [0.5] * 7)], 7, 4)


def test_query_equals_brute_force_on_its_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    d = len(rows[0][1])
    check(whitening.op11_embedding_whitening(spark, SF).collect(), rows, d, min(32, d))


def test_no_variance_and_few_rows(spark):
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    line = whitening.whiten(vectors(spark, [(k, [float(k), float(k), 7.0]) for k in range(5)])).collect()
    first = [r for r in line if r.component == 1]
    assert len(line) == 15 and all(r.whitened is not None and abs(r.explained - 1) < 1e-12 for r in first)
    assert all(r.whitened is None for r in line if r.component > 1) and first[0].identity_error < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [float("nan")])]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.whiten(vectors(spark, rows))
    assert found.columns == whitening.RESULT and found.count() == 0


def test_wide_numbers_stay_exact(spark):
    rows = [(1, [2.0**50, 1.0]), (2, [-(2.0**50), 0.25]), (3, [2.0**60, 0.0])]
    found = whitening.whiten(vectors(spark, rows, "double")).collect()
    x = [[64 * 2**50 + 1000000, 1000064], [-64 * 2**50 + 1000000, 1000016]]
    sums = [sum(c) for c in zip(*x)]
    want = {k + 1: sum((2 * a - s) ** 2 for a, s in zip(r, sums)) for k, r in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in found} == want


def test_lengths_that_differ(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.5, 4.0])]
    assert {r.vec_id for r in whitening.whiten(vectors(spark, rows)).collect()} == {3, 4}
