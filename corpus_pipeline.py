"""From raw documents to token ids: filter, deduplicate twice, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
all but the last return the columns of documents. Stages 1, 2 and 4 use DataFrame
operations only.

1. quality rules: documents that the base rules or the learned rules reject go.
2. exact dedup: of equal texts the row with the largest identifier stays.
3. n-gram Jaccard join: of each class the document with the least identifier stays.
4. mixing: all rows stay; files and rows follow the order of the mixture.
5. SentencePiece: doc_id, n_tokens, token_ids, decoded_sha256, round_trip, and the
   schedule, mix_slot and mix_position.

Rows that are read again come in any order, and the columns of documents have no place
for the schedule. It depends on the identifiers and sources alone, so stage 5 takes it
from the rows that it reads: mix_position is the order to train in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexitrace.llm.common import materialise, table
from lexitrace.llm.exact_dedup import drop_copies
from lexitrace.llm.mixing import in_mixed_order, mix_sources
from lexitrace.llm.ngram_join import one_of_each_class
from lexitrace.llm.quality_rules import fit_rules, keep_good
from lexitrace.llm.sentencepiece_codec import encode_and_check, read_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_and_check(mix_sources(docs), read_model(), also=("mix_slot", "mix_position"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mix_sources", mix), ("sentencepiece", encode)]

#: Learned rules and token ids can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
