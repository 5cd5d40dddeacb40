"""The reference library: look-up, statistics, upsert, delete, ingest.

A library is three tables: media (media_id and what is known of each), fingerprints
(hash, shingle_size, media_id, start_ms, end_ms) and token streams. Changes return new
tables; ``store`` keeps such changes on disk. Fingerprints may have a column ``slot``, the
folder of their hash on disk, by which look-ups leave out what they don't ask for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import materialise

MEDIA = "media_id long, title string, year int, media_type string, season int, episode int, source string, show_title string, episode_title string, duration_seconds int, duration_source string, language string"
KEY = ["title", "year", "media_type", "season", "episode", "source"]
#: What an upsert fills in; the new value wins unless it is null.
FILLED = ["show_title", "episode_title", "duration_seconds", "duration_source", "language"]
EDITABLE = ["title", "year", "media_type", "season", "episode", "source", *FILLED]


#: Folders of an index by hash, fixed for the tables on disk.
SLOTS = 64


def slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def write_slotted(df: DataFrame, key: str, path: str) -> None:
    """``df`` in a folder for each slot of ``key``, sorted by it, with Bloom filters. Large
    slots, those of frequent keys too, are several files."""
    rows = df.withColumn("slot", slot_of(F.col(key))).hint("rebalance", "slot").sortWithinPartitions("slot", key)
    rows.write.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("slot").parquet(path)


def in_slots(indexed: DataFrame, asked: DataFrame, key: str = "hash") -> DataFrame:
    """``indexed`` without the slots that no key of ``asked`` falls in; their files aren't
    read. The driver learns ``SLOTS`` numbers at most. Tables without slots stay as they are."""
    if "slot" not in indexed.columns:
        return indexed
    used = sorted(r[0] for r in asked.select(slot_of(F.col(key))).distinct().collect())
    return indexed if len(used) == SLOTS else indexed.where(F.col("slot").isin(used))


def lookup(fingerprints: DataFrame, query: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Rows of the index whose hash a query holds: query_id, hash, media_id, start_ms.
    ``scope`` (media_id) limits the media; an empty one matches nothing. A hash common
    to many media is a hot key, which adaptive execution splits. ``query`` is best a
    written table."""
    fingerprints = in_slots(fingerprints, query)
    if scope is not None:
        fingerprints = fingerprints.join(scope.select("media_id").distinct(), "media_id", "left_semi")
    return query.select("query_id", "hash").distinct().join(fingerprints.select("hash", "media_id", "start_ms"), "hash")


def document_frequency(fingerprints: DataFrame, parts: int | None = None) -> DataFrame:
    """hash, df: the number of media that hold it; hashes may be numbers (``packed``). With
    ``parts`` hashes alone travel, dealt over so many; that suits fingerprints dealt by media."""
    held = fingerprints.select("hash", "media_id").distinct()
    held = held.select("hash").repartition(parts, "hash") if parts else held
    return held.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))


def media_counts(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_fingerprints"))


def statistics(media: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """One row: n_media, n_fingerprints. Both are counted partially first."""
    tagged = media.select(F.lit(1).alias("m"), F.lit(0).alias("f")).unionByName(fingerprints.select(F.lit(0).alias("m"), F.lit(1).alias("f")))
    return tagged.agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("n_media"), F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("n_fingerprints"))


def scoped_count(fingerprints: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """One row: the fingerprints of the media in ``scope``; of all without it."""
    if scope is not None:
        fingerprints = fingerprints.join(scope.select("media_id").distinct(), "media_id", "left_semi")
    return fingerprints.agg(F.count(F.lit(1)).alias("n_fingerprints"))


def list_media(media: DataFrame) -> DataFrame:
    return media.orderBy(F.asc_nulls_first("title"), F.asc_nulls_first("season"), F.asc_nulls_first("episode"))


def media_info(media: DataFrame, media_id: int) -> DataFrame:
    return media.where(F.col("media_id") == media_id)


def media_hashes(fingerprints: DataFrame, media_id: int) -> DataFrame:
    return fingerprints.where(F.col("media_id") == media_id).select("hash")


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def resolve_episodes(media: DataFrame, wanted: DataFrame) -> DataFrame:
    """All media_id whose title, season and episode equal a wanted row; null equals null."""
    keys = ["title", "season", "episode"]
    want = wanted.select(*keys).distinct()
    return media.join(want, _same(media, want, keys), "left_semi").select("media_id").distinct()


def unprocessed(files: DataFrame, media: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Files whose source has no media with a fingerprint yet."""
    done = media.join(fingerprints.select("media_id").distinct(), "media_id", "left_semi").select("source").distinct()
    return files.join(done, "source", "left_anti")


def in_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in an order over all of them: they are written in
    ranges, and a row's place is that in its range behind the rows of the ranges before."""
    ranged = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.withColumn(name, place).join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def upsert(media: DataFrame, incoming: DataFrame, changed_only: bool = False, top: int | None = None) -> DataFrame:
    """``media`` with ``incoming`` (no ids) merged by the null-safe key; -1 counts as null
    in numbers. Known rows take new values that aren't null; new rows get ids behind the
    largest, or behind ``top``, in the order of their key. Of equal incoming rows the one
    that sorts last wins. With ``changed_only`` just the known rows that were met, and new ones."""
    norm = lambda df: df.select("*", *[(F.coalesce(F.col(k), F.lit(-1)) if k in ("year", "season", "episode") else F.col(k)).alias(f"__{k}") for k in KEY])
    keys = [f"__{k}" for k in KEY]
    # The rest of the row decides which of equal rows wins.
    given = incoming.groupBy(*KEY).agg(*[F.max_by(c, F.struct(F.col(c).isNotNull(), *FILLED)).alias(c) for c in FILLED])
    a, b = norm(media), norm(given)
    both = a.join(b.select(*keys, *[F.col(c).alias(f"new_{c}") for c in FILLED]), _same(a, b, keys), "inner" if changed_only else "left")
    old = both.select(*[a[c] for c in ["media_id", *KEY]], *[F.coalesce(F.col(f"new_{c}"), a[c]).alias(c) for c in FILLED])
    fresh = b.join(a, _same(a, b, keys), "left_anti").select(*KEY, *FILLED)
    last = media.agg(F.coalesce(F.max("media_id"), F.lit(0)).alias("top")) if top is None else media.sparkSession.createDataFrame([(top,)], "top long")
    numbered = in_order(fresh, [F.asc_nulls_first(k) for k in KEY], "place").join(F.broadcast(last), F.lit(True)).withColumn("media_id", F.col("top") + F.col("place"))
    return old.unionByName(numbered.select("media_id", *KEY, *FILLED))


def replace_streams(streams: DataFrame, incoming: DataFrame) -> DataFrame:
    """New streams instead of old ones; an empty new stream changes nothing."""
    fresh = incoming.where(F.size("tokens") > 0)
    return streams.join(fresh.select("media_id"), "media_id", "left_anti").unionByName(fresh.select(*streams.columns))


def update_media(media: DataFrame, media_id: int, **values) -> DataFrame:
    """New values in one row; only known columns."""
    if unknown := set(values) - set(EDITABLE):
        raise ValueError(f"not editable: {sorted(unknown)}")
    here = F.col("media_id") == media_id
    return media.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)).cast(media.schema[c].dataType) for c, v in values.items()})


def delete_media(gone: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Each table without the media_id of ``gone``."""
    ids = gone.select("media_id").distinct()
    return [t.join(ids, "media_id", "left_anti") for t in tables]


def migrate(media: DataFrame) -> DataFrame:
    """An older table with the columns that it lacks, as nulls."""
    empty = media.sparkSession.createDataFrame([], MEDIA)
    return empty.unionByName(media, allowMissingColumns=True).select(*empty.columns)


def listing(media: DataFrame, fingerprints: DataFrame, search: str = "") -> DataFrame:
    """Media with their number of fingerprints (0 without), searched over titles."""
    found = media.join(media_counts(fingerprints), "media_id", "left").withColumn("n_fingerprints", F.coalesce("n_fingerprints", F.lit(0).cast("long")))
    words = F.lower(F.concat_ws(" ", "title", "show_title", "episode_title", "source"))
    return found.where(words.contains(search.lower())) if search else found


def edited(media: DataFrame) -> DataFrame:
    """Edits of the library form: 0 means unknown; minutes become seconds by hand."""
    zero = lambda c: F.nullif(F.col(c), F.lit(0))
    return media.withColumns({"year": zero("year"), "season": zero("season"), "episode": zero("episode"), "duration_seconds": (zero("minutes") * 60).cast("int"), "duration_source": F.when(zero("minutes").isNotNull(), "manual")}).drop("minutes")


def subtitle_runtime(cues: DataFrame) -> DataFrame:
    """media_id, seconds, confidence: the end of the last cue, and whether dialogue is
    dense (40 words a minute) and without gaps over two minutes between neighbours."""
    before = W.partitionBy("media_id").orderBy("pos")
    gap = F.greatest(F.col("start_ms") - F.lag("end_ms").over(before), F.lit(0)) / 1000.0
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    each = cues.select("media_id", "end_ms", words.alias("n"), gap.alias("gap"))
    found = each.groupBy("media_id").agg(F.bround(F.max("end_ms") / 1000.0).cast("int").alias("s"), F.sum("n").alias("words"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))
    seconds = F.when(F.col("s") > 0, F.col("s"))
    rate = F.try_divide(F.col("words"), seconds / 60.0)
    return found.select("media_id", seconds.alias("seconds"), F.when(seconds.isNull() | (rate < 40.0) | (F.col("gap") > 120.0), "low").otherwise("high").alias("confidence"), F.col("words").alias("n_words"), F.col("gap").alias("max_gap_s"))


def with_runtimes(media: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Runtimes of a dimension table (show, season, episode, runtime_min) where it has
    them, else what the media have. Rounding is half to even."""
    known = runtimes.select(F.lower(T.normalise_show(F.col("show"))).alias("k"), F.col("season").alias("s"), F.col("episode").alias("e"), F.bround(F.col("runtime_min") * 60.0).cast("int").alias("online")).dropDuplicates(["k", "s", "e"])
    on = (F.lower(T.normalise_show(F.coalesce("show_title", "title"))) == F.col("k")) & (F.col("season") == F.col("s")) & (F.col("episode") == F.col("e"))
    out = media.join(known, on, "left")
    return out.withColumns({"duration_source": F.when(F.col("online").isNotNull(), "online").otherwise(F.col("duration_source")), "duration_seconds": F.coalesce("online", "duration_seconds")}).drop("k", "s", "e", "online")
