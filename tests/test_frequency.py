"""Frequencies of hashes counted where their media lie, and shuffled only if they may lie in several."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF
from pyspark.sql import functions as F

from lexitrace.operators import fingerprint as FP
from lexitrace.operators import frequency as DF
from lexitrace.operators import library as L
from lexitrace.plans import queries
from lexitrace.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cues(spark, parts):
    rows = [(m, [f"w{(m * k * k + k) % 11}" for k in range(m % 9)]) for m in range(60)]
    rows += [(m, ["same", "words", "in", "all", "media"]) for m in range(60)] + [(7, []), (7, ["é", "same", "words", "in"]), (None, ["same", "words", "in"]), (None, ["no", "id", "here"])]
    df = spark.createDataFrame(rows, "media_id long, tokens array<string>")
    return df.repartition(parts, "media_id").sortWithinPartitions("media_id")


@pytest.mark.parametrize("parts, bits", [(1, 3), (5, 3), (3, 6)])
def test_frequencies_equal_those_of_all_fingerprints(spark, parts, bits, monkeypatch):
    monkeypatch.setattr(DF, "CHUNK", 100)
    tokens = cues(spark, parts)
    prints = FP.library_fingerprints(tokens.withColumns({"start_ms": F.lit(0), "end_ms": F.lit(1)})).select(FP.packed(F.col("hash")).alias("hash"), "media_id")
    want = {r.hash: r.df for r in L.document_frequency(prints).collect()}
    got = DF.document_frequency(tokens, bits).collect()
    assert len(got) == len(want) and {r.hash: r.df for r in got} == want and max(want.values()) == 61
    counts = Counter()
    for r in DF.frequency_counts(tokens, bits).collect():
        counts[r.df] += r.k
    assert counts == Counter(want.values())


def test_frequencies_of_nothing(spark):
    tokens = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "media_id long, tokens array<string>")
    for rows in (tokens, tokens.where("media_id > 2")):
        assert DF.document_frequency(rows, 3).collect() == DF.frequency_counts(rows, 3).collect() == []


def test_a_saturated_filter_loses_nothing(spark, monkeypatch):
    tokens = cues(spark, 2)
    want = sorted(map(tuple, DF.document_frequency(tokens, 3).collect()))
    monkeypatch.setattr(DF, "shared_filter", lambda *a: (spark.sparkContext.broadcast(b"\xff" * (1 << 17)), 20))
    assert sorted(map(tuple, DF.document_frequency(tokens, 3).collect())) == want


def test_packed_numbers_come_back():
    for values in ([5], [5, 5, 6], [1 << 63, (1 << 64) - 1], list(range(9, 9000, 7))):
        assert DF.unpacked(DF.packed(np.array(values, np.uint64), 3), 3).tolist() == values


def test_hashes_are_not_shuffled_one_by_one(spark):
    """Before, a row for each hash of each document was dealt by the hash."""
    text = plan(queries.QUERIES["hash_document_frequency"](spark, SF))
    assert "Exchange hashpartitioning(bucket" in text and "hashpartitioning(hash" not in text


def test_what_one_media_holds_alone_stays(spark):
    """Of a hundred media with words of their own and one line in common only that line travels."""
    rows = [(m, [f"m{m}x{k}" for k in range(50)]) for m in range(100)] + [(m, ["all", "have", "this"]) for m in range(100)]
    tokens = spark.createDataFrame(rows, "media_id long, tokens array<string>").repartition(4, "media_id").sortWithinPartitions("media_id")
    held = DF.shared_filter(tokens, 3)

    def sent(batches):
        yield pa.RecordBatch.from_pydict({"n": [len(shared) for _, each in DF._split(batches, [3, 4, 5], held) for *_, shared in each]}, pa.schema([("n", pa.int64())]))

    assert 100 <= DF._words(tokens).mapInArrow(sent, "n long").agg(F.sum("n")).first()[0] < 200


def test_keys_that_are_there_once_are_read_as_they_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SMALL", 0)
    spark.range(1000).selectExpr("id AS doc_id", "'a' AS text").write.parquet(f"{tmp_path}/once.parquet")
    spark.range(1000).selectExpr("id % 10 AS doc_id", "'a' AS text").write.parquet(f"{tmp_path}/again.parquet")
    once, again = (tables.in_a_row(spark, str(tmp_path), n, "doc_id", "text") for n in ("once", "again"))
    assert "Exchange" not in plan(once) and once.count() == again.count() == 1000
    at = again.withColumn("p", F.spark_partition_id()).groupBy("doc_id").agg(F.count_distinct("p").alias("n"))
    assert {r.n for r in at.collect()} == {1}


@pytest.mark.parametrize("parts, bits", [(1, 3), (5, 3), (3, 6)])
def test_counts_are_those_of_the_frequencies(spark, parts, bits, monkeypatch):
    monkeypatch.setattr(DF, "CHUNK", 100)
    df, counts = DF.frequency_and_counts(cues(spark, parts), bits)
    want, got = Counter(r.df for r in df.collect()), Counter()
    for r in counts.collect():
        got[r.df] += r.k
    assert got == want and len(want) > 2


def test_hashes_of_factors_travel_as_packed_numbers_once(spark):
    """Before, a row for each hash of each document was dealt by the hash."""
    df = queries.QUERIES["hash_idf_factors"](spark, SF)
    df.collect()
    text = plan(df).split("== Initial Plan")[0]
    dealt = [line for line in text.splitlines() if "Exchange hashpartitioning(bucket" in line]
    assert "hashpartitioning(hash" not in text and len([x for x in dealt if "Reused" not in x]) == 1 < len(dealt)


@pytest.mark.parametrize("algorithm", ["md5", "sha1"])
def test_digests_equal_those_of_the_library(algorithm):
    words = [("é" if n % 5 == 2 else "x") * n for n in range(1, 140)] * 40
    for held in (words, words[:1], words[3:3], ["", "a", ""]):
        text, begin = DF._joined(pa.array(["cut", *held], pa.string()).cast(pa.binary()).slice(1))
        assert text.tobytes() == "".join(f"{w} " for w in held).encode()
        got = DF.digests(text, begin[:-1], begin[1:] - 1, algorithm).tolist()
        assert got == [int(hashlib.new(algorithm, w.encode()).hexdigest()[:16], 16) for w in held]
