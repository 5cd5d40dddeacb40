"""Interleave sources to target weights with a Pfair schedule.

Each source's documents form blocks. With w the source's share of the weights, block j
is released at slot floor(j / w) and due by slot ceil((j + 1) / w); each slot takes, of the
blocks released and not yet placed, the one due first. That keeps every source less than
one block from its share of the slots so far, over the whole schedule, until it runs out;
slots that nobody may fill are passed over. Weights become whole numbers in exactly their
proportion, so release times and deadlines are exact. No row is dropped.

Blocks hold ``block_size`` documents whatever the size of the table. The schedule is made
block by block with two heaps, as each decision hangs on all before it: some 200,000 blocks
(1.6 million documents) a second, on the driver, which holds counters of the sources and a
slice of ``SLICE`` blocks. Slices are written to the shared folder, and documents are joined
with them on source and block; the planner broadcasts a small schedule only.

Within a source documents follow the md5 of their identifier. Ranks come from
counts over hash buckets, summed in two steps, and a row number within a bucket, so a
source that holds most rows is never sorted or summed in one task.

Defined results: a null source is a source of its own; a null identifier sorts as
the text 'null'; rows of a source that repeat an identifier get neighbouring positions, in
the order of a hash of their other columns. Sources that ``weights`` leaves out, or gives 0,
have no target: they follow behind the others, mixed by their number of rows. Negative,
infinite or undefined weights are an error. An empty table gives no rows. The sources and
their counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_dir, table

BLOCK_SIZE = 8
#: Blocks of the schedule that the driver holds at once.
SLICE = 1 << 18
TEMPERATURE = 0.5
#: Rows of one hash bucket, on average, at most; hexadecimal digits of a group of buckets.
BUCKET_ROWS, HEAD = 4096, 3


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole numbers in the same proportion: floats are binary fractions."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    unit = max((f.denominator for f in exact.values()), default=1)
    return {k: int(f * unit) for k, f in exact.items()}


def pfair_schedule(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[int, str]]:
    """All of ``pfair_slots``."""
    return list(pfair_slots(blocks, weights))


def pfair_slots(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[int, str]]:
    """(slot, source) of all blocks, in order; ties go to the first name."""
    total, done, slot = sum(weights.values()), dict.fromkeys(blocks, 0), 0
    waiting: list[tuple[int, str]] = [(0, k) for k in blocks if blocks[k]]
    heapify(waiting)
    due: list[tuple[int, str]] = []
    while waiting or due:
        if not due:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, k = heappop(waiting)
            heappush(due, (-(-(done[k] + 1) * total // weights[k]), k))
        _, k = heappop(due)
        yield slot, k
        done[k] += 1
        slot += 1
        if done[k] < blocks[k]:
            heappush(waiting, (done[k] * total // weights[k], k))


def _schedule(counts: dict[str, int], weights: dict[str, float] | None, temperature: float, size: int) -> Iterator[tuple[int, str]]:
    """The schedule of the sources with a target, then of those without."""
    natural = {k: float(n) ** temperature for k, n in counts.items()}
    target = natural if weights is None else {k: w for k, w in weights.items() if w > 0 and k in counts}
    start = 0
    for part in (target, {k: w for k, w in natural.items() if k not in target}):
        last = -1
        for slot, k in pfair_slots({k: -(-counts[k] // size) for k in part}, whole_weights(part)):
            last = slot
            yield start + slot, k
        start += last + 1


def _write_schedule(spark: SparkSession, plan: Iterator[tuple[int, str]], counts: dict[str, int], size: int, slice_blocks: int) -> DataFrame:
    """__key, __block, __slot, __start: the slot of each block and the place of its first
    document in the mixture; written slice by slice, a row for each source in a slice."""
    path, done, at = scratch_dir(spark), dict.fromkeys(counts, 0), 0
    shape = "key string, first long, slots array<long>, starts array<long>"
    while part := list(islice(plan, slice_blocks)):
        rows: dict[str, tuple[int, list[int], list[int]]] = {}
        for slot, k in part:
            _, slots, starts = rows.setdefault(k, (done[k], [], []))
            slots.append(slot)
            starts.append(at)
            at += min(size, counts[k] - size * done[k])
            done[k] += 1
        spark.createDataFrame([(k, *row) for k, row in sorted(rows.items())], shape).coalesce(1).write.mode("append").parquet(path)
    each = spark.read.schema(shape).parquet(path).select(F.col("key").alias("__key"), "first", F.posexplode(F.arrays_zip("slots", "starts")).alias("p", "b"))
    return each.select("__key", (F.col("first") + F.col("p")).alias("__block"), F.col("b.slots").alias("__slot"), F.col("b.starts").alias("__start"))


def _key(source: str | None) -> str:
    return "null" if source is None else f"s{source}"


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, block_size: int = BLOCK_SIZE, id_col: str = "doc_id", source_col: str = "source", slice_blocks: int = SLICE, names: tuple[str, str] = ("mix_slot", "mix_position")) -> DataFrame:
    """``docs`` with ``mix_slot`` and ``mix_position`` (0 to n - 1, without gaps).

    ``weights`` maps sources to target weights; without it a source weighs its
    number of rows to the power ``temperature``. ``names`` are those of the two columns;
    columns of ``docs`` that are named so give way to them.
    """
    docs = docs.drop(*names)
    if weights is not None and not all(math.isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError(f"weights must be finite and not negative: {weights}")
    given = None if weights is None else {_key(k): float(w) for k, w in weights.items()}
    spark, key = docs.sparkSession, F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("null"))
    counts = {r["key"]: r["n"] for r in docs.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return docs.withColumn(names[0], F.lit(0).cast("long")).withColumn(names[1], F.lit(0).cast("long"))
    total, size = sum(counts.values()), block_size
    blocks = _write_schedule(spark, _schedule(counts, given, temperature, size), counts, size, slice_blocks)

    digits = next(d for d in range(HEAD, 16) if total <= BUCKET_ROWS * 16**d)
    marked = docs.withColumn("__key", key).withColumn("__hash", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).withColumn("__bucket", F.substring("__hash", 1, digits))
    sizes = marked.groupBy("__key", "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__head", F.substring("__bucket", 1, HEAD))
    before = lambda by, order: F.sum("__n").over(W.partitionBy(*by).orderBy(order)) - F.col("__n")
    heads = sizes.groupBy("__key", "__head").agg(F.sum("__n").alias("__n")).select("__key", "__head", before(["__key"], "__head").alias("__first"))
    firsts = sizes.select("__key", "__head", "__bucket", before(["__key", "__head"], "__bucket").alias("__more")).join(heads, ["__key", "__head"]).select("__key", "__bucket", (F.col("__first") + F.col("__more")).alias("__first"))
    plain = [F.col(f.name) for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    order = W.partitionBy("__key", "__bucket").orderBy("__hash", id_col, F.xxhash64(*plain))
    ranked = marked.withColumn("__row", F.row_number().over(order) - 1).join(firsts, ["__key", "__bucket"]).withColumn("__rank", F.col("__first") + F.col("__row")).withColumn("__block", F.floor(F.col("__rank") / size))
    placed = ranked.join(blocks, ["__key", "__block"])
    return placed.select(*[F.col(c) for c in docs.columns], F.col("__slot").alias(names[0]), (F.col("__start") + F.pmod(F.col("__rank"), F.lit(size))).alias(names[1]))


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all rows and columns, in files whose order is that of the mixture."""
    slot, place = (next(n for n in (name, *(f"{name}_{k}" for k in range(len(docs.columns)))) if n not in docs.columns) for name in ("mix_slot", "mix_position"))
    mixed = mix_sources(docs, names=(slot, place), **options)
    return mixed.repartitionByRange(place).sortWithinPartitions(place).select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


#: The schedule is simulated block by block by a recursive query over a list of counters.
SQL = f"""
WITH RECURSIVE
n AS (SELECT coalesce('s' || source, 'null') AS k, count(*) AS n FROM documents GROUP BY 1),
z AS (SELECT {BLOCK_SIZE} AS size),
s AS (SELECT k, n, size, CAST(ceil(n / size) AS BIGINT) AS nb, CAST(n ** {TEMPERATURE} * {2**52}::DOUBLE AS HUGEINT) AS w, row_number() OVER (ORDER BY k) AS i FROM n, z),
l AS (SELECT list(nb ORDER BY i) AS nb, list(w ORDER BY i) AS w, sum(w)::HUGEINT AS total, sum(nb)::BIGINT AS every FROM s),
sim AS (
  SELECT CAST(-1 AS HUGEINT) AS slot, list_transform(l.nb, lambda v: CAST(0 AS HUGEINT)) AS done, CAST(0 AS HUGEINT) AS pick, CAST(0 AS BIGINT) AS step FROM l
  UNION ALL
  SELECT t, list_transform(done, lambda v, j: CASE WHEN j = c THEN v + 1 ELSE v END), c, step + 1
  FROM (
    SELECT t, done, step, list_min(list_filter(list_transform(done, lambda v, j: CASE WHEN v < nb[j] AND (v * total) // w[j] <= t
        THEN ((((v + 1) * total + w[j] - 1) // w[j]) * 100000 + j) END), lambda v: v IS NOT NULL)) % 100000 AS c
    FROM (
      SELECT step, done, nb, w, total, greatest(slot + 1, list_min(list_filter(list_transform(done, lambda v, j: CASE WHEN v < nb[j] THEN (v * total) // w[j] END), lambda v: v IS NOT NULL))) AS t
      FROM sim, l WHERE step < every
    )
  )
),
t AS (SELECT slot, pick AS i, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS block FROM sim WHERE step > 0),
d AS (
  SELECT doc_id, source, s.i, s.size, row_number() OVER (PARTITION BY s.i ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id) - 1 AS rnk
  FROM documents JOIN s ON s.k = coalesce('s' || source, 'null')
)
SELECT doc_id, source, CAST(slot AS BIGINT) AS mix_slot, row_number() OVER (ORDER BY slot, rnk) - 1 AS mix_position
FROM d JOIN t ON t.i = d.i AND t.block = rnk // size
"""
