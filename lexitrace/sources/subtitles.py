"""Subtitle files, media listings and runtimes as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: File extensions of media.
VIDEO_EXTENSIONS = [".mp4", ".mkv", ".avi", ".mov", ".m4v", ".mpg", ".mpeg", ".ts", ".wmv", ".flv", ".webm"]
AUDIO_EXTENSIONS = [".m4a", ".wav", ".mp3", ".flac", ".aac", ".ogg"]
MEDIA_EXTENSIONS = [*VIDEO_EXTENSIONS, *AUDIO_EXTENSIONS]
STAMP = r"(?:\d+:)?\d+:\d+(?:[.,]\d*)?"
TIMING = rf"({STAMP})\s*-->\s*({STAMP})"


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1; without a byte-order mark."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def parse_cues(files: DataFrame) -> DataFrame:
    """``files``: source, content (text). source, pos, start_ms, end_ms, text: a row for
    each cue with text, by place. SRT and VTT; other extensions raise an error."""
    ext = F.lower(T.extension(F.col("source")))
    known = F.when(ext.isin(".srt", ".vtt"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not a subtitle format: "), F.col("source"))).cast("string"))
    body = F.regexp_replace(known, "\r\n?", "\n")
    block = files.select("source", F.posexplode(F.split(body, r"\n[ \t]*\n")).alias("pos", "block")).where(F.col("block").rlike(TIMING))
    start, end = F.regexp_extract("block", TIMING, 1), F.regexp_extract("block", TIMING, 2)
    words = F.regexp_replace(F.regexp_replace(F.regexp_extract("block", rf"(?s){TIMING}[^\n]*\n?(.*)$", 3), r"^\s+|\s+$", ""), "\n", " ")
    return block.select("source", "pos", T.timestamp_ms(start).alias("start_ms"), T.timestamp_ms(end).alias("end_ms"), words.alias("text")).where(F.trim("text") != "")


def subtitle_cues(files: DataFrame) -> DataFrame:
    """The cues of subtitle files among ``files`` (path, content as bytes), which may come
    from any source; names tell which they are."""
    subtitles = files.where(F.lower(F.col("path")).rlike(r"\.(srt|vtt)$"))
    return parse_cues(subtitles.select(F.col("path").alias("source"), decode_text(F.col("content")).alias("content")))


def subtitles_among(files: DataFrame) -> DataFrame:
    """path of the subtitle files among ``files`` (path), by their names."""
    return files.select("path").where(F.lower(T.extension(F.col("path"))).isin(".srt", ".vtt"))


def list_subtitles(spark: SparkSession, directory: str) -> DataFrame:
    """path of the subtitle files under ``directory``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob([".srt", ".vtt"])).load(directory)
    return subtitles_among(files)


def read_subtitles(spark: SparkSession, directory: str) -> DataFrame:
    """The cues of all .srt and .vtt files under ``directory``."""
    # The glob keeps other files, videos too, from being opened.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name_glob([".srt", ".vtt"])).load(directory)
    return subtitle_cues(files.select("path", "content"))


def parse_extensions(spec: str | list[str] | None) -> list[str]:
    """Extensions, lower case with a dot, from a list or text; the default if empty."""
    parts = re.split(r"[,\s;]+", spec) if isinstance(spec, str) else list(spec or [])
    found = sorted({"." + p.strip().lower().lstrip(".") for p in parts if p and p.strip()})
    return found or MEDIA_EXTENSIONS


def extensions_of(spec: Column) -> Column:
    """``parse_extensions`` of a column of texts: array of extensions."""
    parts = F.filter(F.split(F.coalesce(spec, F.lit("")), r"[,\s;]+"), lambda x: x != "")
    found = F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.concat(F.lit("."), F.regexp_replace(F.lower(x), r"^\.+", "")))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, MEDIA_EXTENSIONS)))


def name_glob(extensions: list[str]) -> str:
    """A glob of file names with one of the extensions, in either case."""
    either = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*{" + ",".join(map(either, extensions)) + "}"


def media_among(files: DataFrame, root: str, extensions: str | list[str] | None = None, depth: int = -1) -> DataFrame:
    """path: media files among ``files`` (path), ``depth`` folders below ``root`` at most (-1:
    any)."""
    found = files.select("path").where(F.lower(T.extension(F.col("path"))).isin(*parse_extensions(extensions)))
    top = F.lit(re.sub(r"^file:/*", "/", root).rstrip("/"))
    inner = F.ltrim(F.replace(F.regexp_replace("path", "^file:/*", "/"), top, F.lit("")), F.lit("/"))
    return found.where(F.size(F.split(inner, "/")) - 1 <= depth) if depth >= 0 else found


def discover_media(spark: SparkSession, path: str, extensions: str | list[str] | None = None, depth: int = -1) -> DataFrame:
    """path: media files under ``path``, ``depth`` folders deep at most (-1: any), sorted.
    Other names aren't listed, contents aren't read."""
    glob = name_glob(parse_extensions(extensions))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return media_among(files, path, extensions, depth).orderBy("path")


def write_runtimes(runtimes: DataFrame, path: str) -> None:
    """``runtimes`` (episode_id, minutes; an episode once) as JSON objects {episode_id:
    minutes}, one a line, of some ten thousand episodes each."""
    few = F.pmod(F.xxhash64("episode_id"), F.lit(runtimes.count() // 10_000 + 1))
    entry = F.struct("episode_id", F.col("minutes").cast("double"))
    runtimes.groupBy(few).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).select("value").write.text(path)


def read_runtimes(spark: SparkSession, path: str) -> DataFrame:
    """episode_id, minutes from JSON objects {episode_id: minutes}: one in a file, over any
    lines, or one a line."""
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.split("value", r"(?<=\})\s*\n\s*(?=\{)")).alias("value"))
    return each.select(F.explode(F.from_json("value", "map<string,double>")).alias("episode_id", "minutes"))


# -- the driver tables as dialogue ------------------------------------------------------


def documents_as_cues(documents: DataFrame) -> DataFrame:
    """Each line a cue of three seconds: media_id, pos, start_ms, end_ms, text."""
    lines = documents.select(F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    start = F.col("pos").cast("long") * 3000
    return lines.select("media_id", "pos", start.alias("start_ms"), (start + 2500).alias("end_ms"), "text")


def documents_as_lists(documents: DataFrame) -> DataFrame:
    """``documents_as_cues`` with the cues of a row in one: media_id, cues (array of start_ms, text)."""
    cues = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i.cast("long") * 3000).alias("start_ms"), x.alias("text")))
    return documents.select(F.col("doc_id").alias("media_id"), cues.alias("cues"))


def lists_as_cues(lists: DataFrame) -> DataFrame:
    """media_id, start_ms, end_ms, tokens of ``fingerprint.cue_lists`` of documents."""
    each = lists.select("media_id", F.explode("cues").alias("c"))
    return each.select("media_id", "c.start_ms", (F.col("c.start_ms") + 2500).alias("end_ms"), "c.tokens")


def documents_as_media(documents: DataFrame) -> DataFrame:
    """Each document an episode of the show that its source names."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    return documents.select(
        F.col("doc_id").alias("media_id"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.lit(None).cast("int").alias("year"),
        F.lit("tv").alias("media_type"),
        (F.coalesce(number, F.lit(0)) + 1).alias("season"),
        (F.col("doc_id") % 100 + 1).cast("int").alias("episode"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".srt")).alias("source"),
        F.col("source").alias("show_title"),
        F.concat(F.lit("Part "), (F.col("doc_id") % 7).cast("string")).alias("episode_title"),
        F.greatest(F.lit(60), F.floor(F.col("n_chars") / 15)).cast("int").alias("duration_seconds"),
        F.lit("subtitle").alias("duration_source"),
        F.col("lang").alias("language"),
    )


def benchmark_as_windows(benchmark: DataFrame) -> DataFrame:
    """Each item a transcript in three windows: query_id, part, start_s, duration_s, text."""
    words = benchmark.select(F.col("item_id").alias("query_id"), F.split("text", r"\s+").alias("w"))
    third = F.ceil(F.size("w") / 3).cast("int")
    parts = words.select("query_id", third.alias("k"), "w", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("part"))
    return parts.select("query_id", "part", ((F.col("part") + 0.5) / 3 * 1400.0).alias("start_s"), F.lit(1400.0).alias("duration_s"), F.array_join(F.slice("w", F.col("part") * F.col("k") + 1, F.greatest("k", F.lit(1))), " ").alias("text"))
