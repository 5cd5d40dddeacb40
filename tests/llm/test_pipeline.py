import hashlib
from collections import Counter

import corpus_pipeline
from helpers import SCHEMA, WORDS, documents, prose
from test_dedup import jaccard_truth
from test_text_operators import statistics

from lexitrace.llm import mixing
from lexitrace.llm.sentencepiece_codec import Codec, read_model


def small(rng):
    texts = [prose(rng, 80) for _ in range(30)]
    near = texts[3].split()
    near[40] = "changed"
    texts += [texts[0], texts[0], texts[1], " ".join(near), "too short", "la la la " * 40, None, "#* " * 60, prose(rng, 400)]
    return list(enumerate(texts))


def test_stages_equal_brute_force(spark, tmp_path):
    import random

    rows = small(random.Random(2))
    sf = f"file://{tmp_path}"
    documents(spark, rows).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    stats = {i: statistics(t) for i, t in rows}
    left = [(i, t) for i, t in rows if stats[i][0] >= 50 and 100 * stats[i][4] <= 50 * stats[i][0]]
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in left] and kept.columns == docs.columns

    last = {t: i for i, t in left}
    left = sorted((i, t) for t, i in last.items())
    kept = corpus_pipeline.exact(spark, kept, sf)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in left]

    classes = {i: c for i, c, _ in jaccard_truth(left)}
    left = [(i, t) for i, t in left if classes[i] == i]
    kept = corpus_pipeline.near(spark, kept, sf)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in left] and kept.columns == docs.columns

    mixed = corpus_pipeline.mix(spark, kept, sf)
    order = {r.doc_id: r.mix_position for r in mixing.mix_sources(kept).collect()}
    assert [r.doc_id for r in mixed.collect()] == sorted(order, key=order.get) and mixed.columns == docs.columns

    codec = Codec(read_model())
    want = Counter((i, tuple(codec.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in left)
    got = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, tuple(r.token_ids), r.decoded_sha256) for r in got.collect()) == want
    assert len(WORDS(left[0][1])) == 80 and SCHEMA


def test_the_mixture_outlives_the_reread(spark, tmp_path):
    import random

    rng = random.Random(7)
    sf = f"file://{tmp_path}"
    rows = [(k, prose(rng, 60 + 40 * (k % 3), 3000), "en", "big" if k % 10 else "small", 0) for k in range(200)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    path = f"{sf}/out"
    corpus_pipeline.run(spark, sf).repartition(5).write.parquet(path)
    got = {r.doc_id: (r.mix_slot, r.mix_position) for r in spark.read.parquet(path).collect()}
    want = mixing.mix_sources(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert got == {r.doc_id: (r.mix_slot, r.mix_position) for r in want} and len(got) == 200
    assert sorted(p for _, p in got.values()) == list(range(200))


def test_rules_that_were_learnt_reject(spark, tmp_path):
    """Labels teach rules that the base rules don't know; what they reject goes, and
    odd rows and columns pass through all stages."""
    import random

    from lexitrace.llm.quality_rules import fit_rules

    rng = random.Random(11)
    sf = f"file://{tmp_path}"
    good = [(k, prose(rng, 90, 3000)) for k in range(120)]
    symbols = [(200 + k, " ".join(w + "#" * (3 + k % 4) for w in prose(rng, 70, 3000).split())) for k in range(60)]
    lines = [(400 + k, "\n".join([prose(rng, 9, 3000)] * 2 + [prose(rng, 60, 3000)])) for k in range(60)]
    rows = good + symbols + lines + [(None, prose(rng, 90, 3000)), (5, prose(rng, 90, 3000)), (3, good[3][1])]
    docs = documents(spark, rows, extra=True)
    for name in ("mix_slot", "mix_position", "doc", "label", "quality", "toxic", "n_words", "token_ids"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    docs.repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in good + symbols + lines], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = fit_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(rules) >= 2
    kept = corpus_pipeline.quality(spark, docs, sf)
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    assert kept.columns == docs.columns and all(i is None or i < 200 for i, _ in left) and left.total() >= 115
    got = corpus_pipeline.run(spark, sf).collect()
    # Equal texts are one row; rows without an identifier, or with another's, stay.
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in left)
    assert sorted(r.mix_position for r in got) == list(range(len(got))) and all(r.round_trip for r in got)


def test_no_documents(spark, tmp_path):
    sf = f"file://{tmp_path}"
    documents(spark, []).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
