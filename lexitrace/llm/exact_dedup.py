"""Exact deduplication through a log-structured merge index.

A memtable is a share of the input partitions. ``flush`` writes each as a run sorted by
digest; ``fan`` runs of a level are merged into one of the next, which keeps the smallest and
largest identifier and the number of rows for each digest and text hash. Live runs have a
filter beside them: a bitmap over their digests, of a size that follows their number. A
full compaction leaves one run. The state of an index is its folder: a manifest lists the
live runs, so it can be opened again.

``lookup`` asks the index about new rows: digests that the filter of a run passes are joined
with that run, the others never touch it; a hit is known only if the sha256 of its text is
that of the entry, as the index holds no texts. ``resolve`` takes the identifier to keep and
the size of a group from the compacted run; rows whose digest occurs twice or more, by a
bitmap, are hits, and hits are verified byte for byte by grouping on the text itself, which
confirms an entry or splits it. Partial aggregation merges copies before the shuffle, so a text that
holds a third of all rows arrives as one row per map task.

Defined results: null text counts as empty. Rows with a null identifier take part
and keep a row only if all rows of their group have none. Rows that repeat both
identifier and text are the same document: each counts in ``group_size`` and all
of them carry the verdict of their identifier. An empty table gives no rows. Only
the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filter_bits, materialise, may_contain, member_bitmaps, scratch_dir, table

RUN = "id long, digest long, sha string"
MERGED = "digest long, sha string, min_id long, max_id long, n long"


class ExactDedupIndex:
    """An index in a folder of its own; ``flush``, ``compact`` and look-ups in any order."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "smallest", fan: int = 4) -> None:
        """Opens the index at ``path``, or begins one there."""
        self.spark, self.path, self.keep, self.fan = spark, path, keep, fan
        #: Runs of rows, all of them; live runs by level, [0] being runs of rows; a number.
        self.state: dict = {"log": [], "levels": [[]], "next": 0, "bits": {}}
        if found := self._manifests():
            self.state = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest-{found[-1]:08d}").collect()))

    def _manifests(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        done = [n for n in names if n.startswith("manifest-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[9:]) for n in done)

    def _commit(self) -> None:
        text = self.spark.createDataFrame([(json.dumps(self.state),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest-{self.state['next']:08d}")

    def _name(self, kind: str) -> str:
        self.state["next"] += 1
        return f"{kind}-{self.state['next']:08d}"

    def _read(self, schema: str, *names: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _entries(self, level: int, *names: str) -> DataFrame:
        """What runs of a level say of their digests; runs of rows say it row by row."""
        if level:
            return self._read(MERGED, *names)
        return self._read(RUN, *names).select("digest", "sha", F.col("id").alias("min_id"), F.col("id").alias("max_id"), F.lit(1).cast("long").alias("n"))

    def _filter(self, name: str) -> None:
        """The filter of a run that stays live."""
        digests = self.spark.read.parquet(f"{self.path}/{name}").select("digest")
        bits = self.state["bits"][name] = filter_bits(digests.count())
        member_bitmaps(digests, "digest", bits).coalesce(1).write.parquet(f"{self.path}/filter/{name}")

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtables: int = 1) -> None:
        """Sorted runs of ``docs``, one for each memtable, no shuffle; then a compaction of
        the levels that are full."""
        name, text = self._name("run"), F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("digest"), F.sha2(text, 256).alias("sha"), (F.spark_partition_id() % memtables).alias("memtable"))
        rows.sortWithinPartitions("memtable", "digest").write.partitionBy("memtable").parquet(f"{self.path}/{name}")
        made = [f"{name}/memtable={k}" for k in range(memtables) if self._exists(f"{name}/memtable={k}")]
        self.state["log"] += made
        self.state["levels"][0] += made
        level = 0
        while len(self.state["levels"][level]) >= self.fan:
            self._merge([level], level + 1)
            level += 1
        for run in (r for names in self.state["levels"] for r in names if r not in self.state["bits"]):
            self._filter(run)
        self._commit()

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _merge(self, levels: list[int], into: int) -> None:
        """Replace all runs of some levels by one of level ``into``."""
        live = self.state["levels"]
        live += [[] for _ in range(into + 1 - len(live))]
        parts = [self._entries(k, *live[k]) for k in levels if live[k]]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        name = self._name("merged")
        grouped = merged.groupBy("digest", "sha").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n"))
        grouped.sortWithinPartitions("digest").write.parquet(f"{self.path}/{name}")
        for k in levels:
            for gone in live[k]:
                self.state["bits"].pop(gone, None)
            live[k] = []
        live[into].append(name)

    def compact(self) -> DataFrame:
        """Merge all live runs into one, unless there is just one merged run."""
        live = self.state["levels"]
        runs = [(k, n) for k, names in enumerate(live) for n in names]
        if not runs:
            return self._read(MERGED)
        if len(runs) > 1 or runs[0][0] == 0:
            self._merge(list(range(len(live))), max(1, len(live) - 1))
            self._filter(self.state["levels"][-1][-1])
            self._commit()
        return self._read(MERGED, *[n for names in self.state["levels"][1:] for n in names])

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, known_id, known: for each row of ``docs`` the smallest identifier and the
        number of rows of the index with its text, null and 0 if there are none."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.sha2(text, 256).alias("sha")))
        asked, found = rows.select("digest", "sha").distinct(), self._read(MERGED)
        for level, names in enumerate(self.state["levels"]):
            for name in names:
                maybe = may_contain(asked, "digest", self.spark.read.parquet(f"{self.path}/filter/{name}"), bits=self.state["bits"][name])
                found = found.unionByName(self._entries(level, name).join(maybe, ["digest", "sha"], "left_semi"))
        met = found.groupBy("digest", "sha").agg(F.min("min_id").alias("known_id"), F.sum("n").alias("known"))
        return rows.join(met, ["digest", "sha"], "left").select("doc_id", "known_id", F.coalesce("known", F.lit(0)).cast("long").alias("known"))

    def _verified(self, hits: DataFrame) -> DataFrame:
        """digest, sha, best, n of groups of two or more among the hits (id, body, digest).
        An entry that has one text only is confirmed: the index knows its group. Another is
        split into its texts."""
        pick = F.max if self.keep == "largest" else F.min
        bodies = hits.groupBy("digest", "body").agg(pick("id").alias("own_best"), F.count(F.lit(1)).alias("own_n")).select("digest", F.sha2("body", 256).alias("sha"), "own_best", "own_n")
        told = bodies.withColumn("texts", F.count(F.lit(1)).over(W.partitionBy("digest", "sha")))
        index = self.compact().where("n > 1").select("digest", "sha", F.col("max_id" if self.keep == "largest" else "min_id").alias("best"), "n")
        known = told.join(index, ["digest", "sha"])
        alone = F.col("texts") == 1
        return known.select("digest", "sha", F.when(alone, F.col("best")).otherwise(F.col("own_best")).alias("best"), F.when(alone, F.col("n")).otherwise(F.col("own_n")).alias("n")).where("n > 1")

    def _bitmaps(self) -> tuple[DataFrame, int]:
        """A filter of the digests that occur twice or more, and its size in bits."""
        twice = self.compact().where("n > 1").select("digest")
        bits = filter_bits(twice.count())
        return member_bitmaps(twice, "digest", bits), bits

    def resolve(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The verdict of every flushed row; ``docs`` are the rows that were flushed."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("body")).withColumn("digest", F.xxhash64("body"))
        bitmaps, bits = self._bitmaps()
        verified = self._verified(may_contain(rows, "digest", bitmaps, bits=bits))
        every = self._read(RUN, *self.state["log"])
        return every.join(verified, ["digest", "sha"], "left").select(
            F.col("id").alias("doc_id"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("best").eqNullSafe(F.col("id"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )

    def survivors(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The flushed rows that stay, with all columns: one for each text. Rows that
        the filter passes over stay where they are; only hits are shuffled."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("body"))
        bitmaps, bits = self._bitmaps()
        marked = may_contain(rows.withColumn("digest", F.xxhash64("body")), "digest", bitmaps, keep=True, bits=bits)
        hits = marked.where("maybe")
        verified = materialise(self._verified(hits))
        met = hits.withColumn("sha", F.sha2("body", 256)).drop("body", "maybe").join(verified, ["digest", "sha"], "left")
        stay = met.where(F.col("n").isNull() | F.col("best").eqNullSafe(F.col("id"))).dropDuplicates(["digest", "sha"])
        return marked.where(~F.col("maybe")).select("row.*").unionByName(stay.select("row.*"))


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Flush, compact and resolve ``docs`` in a new index in the shared folder."""
    index = ExactDedupIndex(docs.sparkSession, scratch_dir(docs.sparkSession), keep)
    index.flush(docs, id_col, text_col, index.fan)
    return index.resolve(docs, id_col, text_col)


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each text."""
    index = ExactDedupIndex(docs.sparkSession, scratch_dir(docs.sparkSession), keep)
    index.flush(docs, id_col, text_col, index.fan)
    return index.survivors(docs, id_col, text_col)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
