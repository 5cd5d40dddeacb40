"""Languages by trigrams: held-out accuracy, odd texts."""

from oracle import SF
from pyspark.sql import functions as F

from lexitrace.operators import language as LM


def test_held_out_accuracy(spark):
    """Trained on even documents, asked about odd ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    model = LM.train(docs.where("doc_id % 2 = 0"))
    assert model.languages == ["de", "en", "es", "fr"] and model.grams.count() <= LM.MOST_GRAMS
    odd = docs.where("doc_id % 2 = 1 AND length(trim(text)) >= 40")
    told = LM.detect(odd, model, "doc_id").join(odd.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("language") == F.col("lang")).cast("int")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    assert told["n"] > 80 and told["a"] >= 0.97


def test_odd_texts(spark):
    train = spark.createDataFrame([("a", "lorem ipsum dolor"), ("b", "hjk hjk wxyz"), (None, "zzz")], "lang string, text string")
    model = LM.train(train)
    rows = [(1, "lorem dolor lorem " * 5), (2, "wxyz hjk " * 9), (3, "lorem"), (4, None), (5, ""), (6, "1234 " * 20), (7, "дом " * 20), (None, "ipsum " * 10), (8, "lorem wxyz " * 1 + "x" * 60)]
    got = {r.k: r.language for r in LM.detect(spark.createDataFrame(rows, "k long, text string"), model, "k").collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 5, 6, 7, None)} == {1: "a", 2: "b", 3: None, 4: None, 5: None, 6: None, 7: None, None: "a"}
    assert LM.train(train, most_grams=3).grams.count() == 3
    none = LM.train(train.where("lang = 'c'"))
    assert none.languages == [] and {r.language for r in LM.detect(spark.createDataFrame(rows, "k long, text string"), none, "k").collect()} == {None}
