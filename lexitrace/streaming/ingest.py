"""An extension: a library that grows from a stream of cues or of subtitle files.

``ingest`` fingerprints each micro-batch of cues by the same narrow operators as a batch build
and appends it to two folders. A batch that is run again after a failure overwrites its own
folder, so results are exactly once.

``grow`` builds a ``Library`` from files as they come; it can be read, asked and changed all
the while. Files that have fingerprints already are left out, so a batch that is run again
adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import FingerprintConfig
from ..operators.fingerprint import cue_tokens, library_fingerprints, token_streams
from ..operators.identify import Library
from ..sources.subtitles import name_glob


def ingest(cues: DataFrame, library: str, checkpoint: str, config: FingerprintConfig = FingerprintConfig(), **trigger) -> StreamingQuery:
    """Starts a query that writes ``library``/fingerprints and /streams, by batch. All
    cues of a media must arrive in one batch (one file, say)."""

    def store(batch: DataFrame, number: int) -> None:
        tokens = cue_tokens(batch, config).persist()
        try:
            library_fingerprints(tokens, config).write.mode("overwrite").parquet(f"{library}/fingerprints/batch={number}")
            token_streams(tokens).write.mode("overwrite").parquet(f"{library}/streams/batch={number}")
        finally:
            tokens.unpersist()

    return cues.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def subtitle_stream(spark: SparkSession, directory: str, most_files: int = 10_000) -> DataFrame:
    """path, content of subtitle files as they appear under ``directory``, at most so many a
    batch."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    options = {"recursiveFileLookup": "true", "pathGlobFilter": name_glob([".srt", ".vtt"]), "maxFilesPerTrigger": str(most_files)}
    return files.options(**options).load(directory).select("path", "content")


def grow(files: DataFrame, library: Library, checkpoint: str, options: dict | None = None, **trigger) -> StreamingQuery:
    """Starts a query that builds ``library`` from a stream of path and content; ``options`` are
    those of ``Library.build``."""

    def store(batch: DataFrame, number: int) -> None:
        library.build(batch, **(options or {}))

    return files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
