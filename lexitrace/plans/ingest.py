"""Registered queries over subtitle files, libraries on disk, reports and browsing.

Files are made from ``benchmark``, a stated set of items: each item a subtitle file whose
cues hold six words. The SQL builds cues from the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FingerprintConfig
from ..functions import text as T
from ..functions.phonetics import encode_vocabulary, phonetic_tokens
from ..operators import fingerprint as FP
from ..operators import language as LM
from ..operators import library as L
from ..operators import sampling
from ..operators import scoring as S
from ..operators import verdict as V
from ..operators.identify import Library, transcribe_windows
from ..sources import sinks
from ..sources import subtitles as SRC
from ..sources.scratch import scratch_dir
from ..sources.tables import deal_table, read_table
from .queries import WINDOWS, _BUILT, _CAND, _DICE, _LCS, _NAMES, _PARSED, _VERDICT, _candidates, _clean, _fingerprints, _key, _media, _part, _query, _results, _shingles, _streams, _token_idf, _transcripts, _words, query

WORDS_OF_CUE = 6


def _stamp(ms: F.Column, mark: str) -> F.Column:
    part = lambda unit, of: F.floor(ms / unit) % of
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", part(3600000, 1 << 40), part(60000, 60), part(1000, 60), part(1, 1000))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, as a source of binary files gives them: items as Show.S01Exx.srt
    (even: line ends of either kind, with and without a byte-order mark) or .vtt (odd, a
    folder deeper), amid other files."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), words.alias("w"))
    last = F.floor((F.size("w") - 1) / WORDS_OF_CUE)
    said = lambda k: F.array_join(F.slice("w", (k * WORDS_OF_CUE + 1).cast("int"), WORDS_OF_CUE), " ")

    def cue(k: F.Column, mark: str) -> F.Column:
        return F.concat(_stamp(k * 3000, mark), F.lit(" --> "), _stamp(k * 3000 + 2500, mark), F.lit("\n"), said(k))

    each = lambda f: F.array_join(F.when(F.size("w") > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), f)), "\n\n")
    srt = each(lambda k: F.concat((k + 1).cast("string"), F.lit("\n"), cue(k, ",")))
    srt = F.when(F.col("i") % 3 == 0, F.replace(srt, F.lit("\n"), F.lit("\r\n"))).otherwise(srt)
    srt = F.when(F.col("i") % 4 == 0, F.concat(F.lit("\ufeff"), srt)).otherwise(srt)
    vtt = F.concat(F.lit("WEBVTT\n\n"), each(lambda k: cue(k, ".")))
    odd, name = F.col("i") % 2 == 1, F.format_string("Show.S01E%02d", "i")
    subtitle = F.struct(F.concat(F.lit(f"{_ROOT}/"), F.when(odd, "deep/").otherwise(""), name, F.when(odd, ".vtt").otherwise(".srt")).alias("path"), F.encode(F.when(odd, vtt).otherwise(srt), "UTF-8").alias("content"))
    other = F.struct(F.concat(F.lit(f"{_ROOT}/"), F.repeat(F.lit("deep/"), (F.col("i") % 3).cast("int")), name, F.when(F.col("i") % 5 > 0, ".MKV").otherwise(".txt")).alias("path"), F.encode(F.lit("x"), "UTF-8").alias("content"))
    return items.select(F.explode(F.array(subtitle, other)).alias("f")).select("f.*")


_ROOT = "/shows"
_FILE = "'Show.S01E' || lpad(CAST(item_id AS VARCHAR), CAST(greatest(2, length(CAST(item_id AS VARCHAR))) AS INTEGER), '0')"
_FILES = f"""i AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark),
fcue AS (SELECT item_id, {_FILE} || CASE WHEN item_id % 2 = 1 THEN '.vtt' ELSE '.srt' END AS source, k AS n, k * 3000 AS start_ms, k * 3000 + 2500 AS end_ms, array_to_string(w[k * {WORDS_OF_CUE} + 1:k * {WORDS_OF_CUE} + {WORDS_OF_CUE}], ' ') AS text
  FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / {WORDS_OF_CUE}) AS BIGINT))) AS k FROM i))"""


def _cues(spark, sf_dir):
    return SRC.subtitle_cues(_files(spark, sf_dir)).withColumn("source", T.base_name(F.col("source")))


@query(f"WITH {_FILES} SELECT source, n AS pos, start_ms, end_ms, text FROM fcue WHERE item_id % 2 = 0")
def srt_scan(spark, sf_dir):
    return _cues(spark, sf_dir).where(F.col("source").endswith(".srt")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_FILES} SELECT source, n + 1 AS pos, start_ms, end_ms, text FROM fcue WHERE item_id % 2 = 1")
def vtt_scan(spark, sf_dir):
    return _cues(spark, sf_dir).where(F.col("source").endswith(".vtt")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_FILES} SELECT right(source, 4) AS format, count(DISTINCT source) AS files, count(*) AS cues FROM fcue GROUP BY 1")
def subtitle_formats(spark, sf_dir):
    return _cues(spark, sf_dir).groupBy(T.extension(F.col("source")).alias("format")).agg(F.count_distinct("source").alias("files"), F.count(F.lit(1)).alias("cues"))


@query(f"SELECT {_FILE} || CASE WHEN item_id % 2 = 1 THEN '.vtt' ELSE '.srt' END AS source FROM benchmark")
def subtitle_listing(spark, sf_dir):
    return SRC.subtitles_among(_files(spark, sf_dir)).select(T.base_name(F.col("path")).alias("source"))


@query(f"SELECT {_FILE} || '.MKV' AS name FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 3 <= 1")
def media_discovery(spark, sf_dir):
    return SRC.media_among(_files(spark, sf_dir), _ROOT, "mkv; .MP4", depth=1).select(T.base_name(F.col("path")).alias("name"))


#: Lists as people write them, from the languages and sources of documents.
_SPECS = "CASE doc_id % 4 WHEN 0 THEN lang || ', .' || upper(source) || ';' || lang WHEN 1 THEN '  ..' || source || ' ' || lang WHEN 2 THEN ' ;, ' ELSE upper(lang) END"
_DEFAULTS = ", ".join(f"'{e}'" for e in SRC.MEDIA_EXTENSIONS)


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(string_split_regex({_SPECS}, '[,\\s;]+'), lambda x: x <> '') AS p FROM documents),
e AS (SELECT doc_id, list_sort(list_distinct(list_transform(p, lambda x: '.' || regexp_replace(lower(x), '^\\.+', '')))) AS e FROM p)
SELECT doc_id, array_to_string(CASE WHEN len(e) > 0 THEN e ELSE [{_DEFAULTS}] END, ' ') AS found FROM e"""
)
def extension_lists(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_SPECS} AS spec")
    return docs.select("doc_id", F.array_join(SRC.extensions_of(F.col("spec")), " ").alias("found"))


_POINTS = "CASE doc_id % 3 WHEN 0 THEN (n_chars % 100) || '%,0.' || (n_chars % 7 + 1) || ';' || (2 + n_chars % 97) WHEN 1 THEN ' .5  ' || (n_chars % 100) ELSE '' END"


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(string_split_regex({_POINTS}, '[,\\s;]+'), lambda x: x <> '') AS p FROM documents),
v AS (SELECT doc_id, list_transform(p, lambda x: CASE WHEN ends_with(x, '%') OR CAST(rtrim(x, '%') AS DOUBLE) > 1 THEN CAST(rtrim(x, '%') AS DOUBLE) / 100 ELSE CAST(rtrim(x, '%') AS DOUBLE) END) AS v FROM p)
SELECT doc_id, array_to_string(list_transform(v, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ' ') AS points FROM v"""
)
def point_lists(spark, sf_dir):
    """Fractions in ten thousandths."""
    docs = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_POINTS} AS spec")
    return docs.select("doc_id", F.array_join(F.transform(sampling.points_of(F.col("spec")), lambda x: F.round(x * 10000).cast("long").cast("string")), " ").alias("points"))


_STAMPS = "CASE doc_id % 6 WHEN 0 THEN '01:02:03,' || doc_id % 1000 WHEN 1 THEN '00:' || doc_id % 60 || ':07.5' WHEN 2 THEN doc_id % 60 || ':09.1234' WHEN 3 THEN '00:00:' || doc_id % 60 WHEN 4 THEN 'x' || doc_id ELSE '1:2:3:4' END"


@query(
    f"""WITH s AS (SELECT doc_id, replace({_STAMPS}, ',', '.') AS s FROM documents), p AS (SELECT *, string_split(split_part(s, '.', 1), ':') AS p, rpad(split_part(s, '.', 2), 3, '0') AS f FROM s)
SELECT doc_id, CASE WHEN s LIKE 'x%' OR len(p) NOT IN (2, 3) THEN 0 ELSE ((CASE WHEN len(p) = 3 THEN CAST(p[1] AS BIGINT) ELSE 0 END) * 3600 + CAST(p[-2] AS BIGINT) * 60 + CAST(p[-1] AS BIGINT)) * 1000 + CAST(f[1:3] AS BIGINT) END AS ms FROM p"""
)
def timestamps(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_STAMPS} AS s").select("doc_id", T.timestamp_ms(F.col("s")).alias("ms"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 3 = 1 THEN regexp_replace(text, '[^\\x{0}-\\x{FF}]', '?', 'g') ELSE text END) AS text_md5 FROM documents")
def encoding_ladder(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    narrow = F.encode(F.regexp_replace("text", "[^\\x{0}-\\x{FF}]", "?"), "ISO-8859-1")
    raw = F.when(F.col("doc_id") % 3 == 1, narrow).when(F.col("doc_id") % 3 == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", F.md5(SRC.decode_text(raw)).alias("text_md5"))


@query("SELECT 'S01E' || lpad(CAST(item_id % 50 AS VARCHAR), 2, '0') AS episode_id, max(item_id / 2.0::DOUBLE) AS minutes FROM benchmark GROUP BY 1")
def runtimes_source(spark, sf_dir):
    path = scratch_dir(spark)
    episode = F.format_string("S01E%02d", F.col("item_id") % 50).alias("episode_id")
    SRC.write_runtimes(read_table(spark, sf_dir, "benchmark").groupBy(episode).agg(F.max(F.col("item_id") / 2.0).alias("minutes")), path)
    return SRC.read_runtimes(spark, path)


@query("SELECT doc_id AS media_id, CASE WHEN toxic IS NOT NULL THEN 'online' ELSE 'subtitle' END AS duration_source, CASE WHEN toxic IS NOT NULL THEN 60 * (30 + doc_id % 5) ELSE greatest(60, n_chars // 15) END::INTEGER AS duration_seconds FROM documents LEFT JOIN labels USING (doc_id)")
def runtime_lookup(spark, sf_dir):
    media = _media(spark, sf_dir).withColumns({"show_title": F.concat(F.lit("Show "), "media_id", F.lit("  (1999)"))})
    known = read_table(spark, sf_dir, "labels").join(media.select(F.col("media_id").alias("doc_id"), "season", "episode"), "doc_id")
    runtimes = known.select(F.concat(F.lit("SHOW "), "doc_id").alias("show"), "season", "episode", (30 + F.col("doc_id") % 5).alias("runtime_min"))
    return L.with_runtimes(media, runtimes).select("media_id", "duration_source", "duration_seconds")


class _Echo:
    def transcribe(self, path, start_s, len_s):
        return f"{path} {start_s:.0f} {len_s:.0f}"


@query("SELECT item_id AS query_id, k AS part, (k * 30.0::DOUBLE) AS start_s, 90.0::DOUBLE AS duration_s, 'f' || item_id || ' ' || (k * 30) || ' 12' AS text FROM (SELECT item_id, unnest([0, 1, 2]) AS k FROM benchmark)")
def transcriber_hook(spark, sf_dir):
    files = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("f"), "item_id").alias("path"), F.lit(90.0).alias("duration_s"), sampling.sample_windows(F.lit(90.0), F.array(F.lit(0.0), F.lit(1 / 3), F.lit(2 / 3)), 12.0).alias("windows"))
    return transcribe_windows(files, _Echo())


# -- libraries on disk ------------------------------------------------------------------

#: Another language than English: tokens are the words.
_CONFIG = FingerprintConfig(language="de")


def _library(spark: SparkSession, sf_dir: str) -> Library:
    """Built in two steps: the .vtt files as a show, then all; the second step appends."""
    key = _key(spark, sf_dir, "library")
    if key not in _BUILT:
        library, files = Library(spark, scratch_dir(spark), _CONFIG), _files(spark, sf_dir)
        library.build_show("Odd Show 1999", files.where(F.col("path").startswith(f"{_ROOT}/deep/")))
        library.build(files)
        _BUILT[key] = library.path
    return Library(spark, _BUILT[key], _CONFIG)


def _changed(spark: SparkSession, sf_dir: str) -> Library:
    """A library that has lost every fifth item, has other titles for every seventh, and
    streams that run backwards for every third of what was left."""
    key = _key(spark, sf_dir, "changed")
    if key not in _BUILT:
        library = Library(spark, scratch_dir(spark), _CONFIG)
        library.build(_files(spark, sf_dir))
        item = F.regexp_extract("source", r"E(\d+)\.", 1).cast("long")
        media = library.table("media").select("media_id", item.alias("item_id"))
        library.update(media.where("item_id % 7 = 1").select("media_id", F.lit("New").alias("title"), F.lit(9).alias("season"), F.lit(None).cast("int").alias("duration_seconds")))
        library.delete(media.where("item_id % 5 = 0"))
        words = _transcripts(spark, sf_dir).where("query_id % 3 = 0").select(F.col("query_id").alias("item_id"), F.reverse("tokens").alias("tokens"))
        library.replace_streams(media.join(words, "item_id").select("media_id", "tokens", F.transform("tokens", lambda t, i: i.cast("long")).alias("starts")))
        _BUILT[key] = library.path
    return Library(spark, _BUILT[key], _CONFIG)


_FTOK = f"{_FILES}, ftok AS (SELECT item_id AS media_id, source, n AS pos, start_ms, end_ms, {_words('text')} AS w FROM fcue), ffp AS ({_shingles('ftok', 'media_id, source, start_ms, end_ms')})"


@query(
    f"""WITH {_FTOK}, f AS (SELECT source, count(*) AS n_fingerprints, count(DISTINCT hash) AS n_distinct, max(end_ms) AS last_ms FROM ffp GROUP BY 1),
t AS (SELECT source, sum(len(w))::BIGINT AS n_tokens FROM ftok GROUP BY 1), d AS (SELECT source, round_even(max(end_ms) / 1000.0, 0)::INTEGER AS duration_seconds FROM fcue GROUP BY 1)
SELECT source, 1 AS season, item_id::INTEGER AS episode, CASE WHEN item_id % 2 = 1 THEN 1999 END AS year, CASE WHEN item_id % 2 = 1 THEN 'Odd Show' ELSE 'Show' END AS title, duration_seconds, n_fingerprints, n_distinct, n_tokens
FROM (SELECT DISTINCT item_id, source FROM fcue) JOIN f USING (source) JOIN t USING (source) JOIN d USING (source)"""
)
def library_build(spark, sf_dir):
    library = _library(spark, sf_dir)
    counted = library.table("fingerprints").groupBy("media_id").agg(F.count(F.lit(1)).alias("n_fingerprints"), F.count_distinct("hash").alias("n_distinct"))
    sizes = library.table("streams").select("media_id", F.size("tokens").cast("long").alias("n_tokens"))
    media = library.table("media").select("media_id", "source", "season", "episode", "year", "title", "duration_seconds")
    return media.join(counted, "media_id").join(sizes, "media_id").drop("media_id")


@query(f"WITH {_FTOK}, m AS (SELECT count(DISTINCT source) AS n FROM fcue), d AS (SELECT hash, count(DISTINCT media_id) AS df FROM ffp GROUP BY 1), x AS (SELECT hash, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM d, m), a AS (SELECT avg(idf) AS mean FROM x) SELECT hash, round(least(3.0::DOUBLE, greatest(0.35::DOUBLE, idf / mean)), 6) AS factor FROM x, a")
def library_hash_idf(spark, sf_dir):
    """From the frequencies that the two builds have written and summed."""
    return _library(spark, sf_dir).hash_factors().select("hash", F.round("factor", 6).alias("factor"))


@query(f"WITH {_FTOK}, d AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT media_id, unnest(w) AS t FROM ftok) GROUP BY 1), m AS (SELECT count(DISTINCT media_id) AS n FROM ftok WHERE len(w) > 0) SELECT t AS token, df, round(ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE, 6) AS idf FROM d, m")
def library_token_idf(spark, sf_dir):
    return _library(spark, sf_dir).token_idf().select("token", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


@query(f"WITH {_FILES} SELECT count(DISTINCT source) AS skipped, 0 AS files, 0 AS fingerprints FROM fcue")
def library_rebuild(spark, sf_dir):
    """Another build of known files adds nothing."""
    done = _library(spark, sf_dir).build(_files(spark, sf_dir))
    return spark.createDataFrame([(done["skipped"], done["files"], done["fingerprints"])], "skipped long, files int, fingerprints int")


_LEFT = "item_id % 5 <> 0"
_NEWSTREAM = f"""{_FTOK}, left_ AS (SELECT DISTINCT item_id, source FROM fcue WHERE {_LEFT}), own AS (SELECT media_id AS item_id, flatten(list(w ORDER BY pos)) AS tokens FROM ftok WHERE len(w) > 0 GROUP BY 1),
back AS (SELECT item_id, list_reverse({_words('text')}) AS tokens FROM benchmark WHERE item_id % 3 = 0),
now_ AS (SELECT source, CASE WHEN len(back.tokens) > 0 THEN back.tokens ELSE own.tokens END AS tokens FROM left_ LEFT JOIN own USING (item_id) LEFT JOIN back USING (item_id) WHERE own.tokens IS NOT NULL OR len(back.tokens) > 0)"""


@query(
    f"""WITH {_FTOK}, f AS (SELECT source, count(*) AS n_fingerprints FROM ffp GROUP BY 1), d AS (SELECT item_id, source, round_even(max(end_ms) / 1000.0, 0)::INTEGER AS duration_seconds FROM fcue WHERE {_LEFT} GROUP BY 1, 2)
SELECT source, CASE WHEN item_id % 7 = 1 THEN 'New' ELSE 'Show' END AS title, CASE WHEN item_id % 7 = 1 THEN 9 ELSE 1 END AS season, CASE WHEN item_id % 7 <> 1 THEN duration_seconds END AS duration_seconds, n_fingerprints FROM d LEFT JOIN f USING (source)"""
)
def library_changes(spark, sf_dir):
    """Media and their fingerprints after deletions and edits on disk."""
    library = _changed(spark, sf_dir)
    return library.table("media").join(L.media_counts(library.table("fingerprints")), "media_id", "left").select("source", "title", "season", "duration_seconds", "n_fingerprints")


@query(f"WITH {_NEWSTREAM} SELECT source, md5(array_to_string(tokens, ' ')) AS stream FROM now_")
def library_changed_streams(spark, sf_dir):
    library = _changed(spark, sf_dir)
    return library.table("streams").join(library.table("media").select("media_id", "source"), "media_id").select("source", F.md5(F.array_join("tokens", " ")).alias("stream"))


@query(f"WITH {_NEWSTREAM} SELECT source, t AS token, count(*) AS n FROM (SELECT source, unnest(tokens) AS t FROM now_) GROUP BY 1, 2")
def library_changed_postings(spark, sf_dir):
    library = _changed(spark, sf_dir)
    return library.table("postings").join(library.table("media").select("media_id", "source"), "media_id").select("source", "token", "n")


@query(f"WITH {_FTOK}, m AS (SELECT count(DISTINCT source) AS n FROM fcue WHERE {_LEFT}), d AS (SELECT hash, count(DISTINCT media_id) AS df FROM ffp WHERE media_id % 5 <> 0 GROUP BY 1), x AS (SELECT hash, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM d, m), a AS (SELECT avg(idf) AS mean FROM x) SELECT hash, round(least(3.0::DOUBLE, greatest(0.35::DOUBLE, idf / mean)), 6) AS factor FROM x, a")
def library_changed_hash_idf(spark, sf_dir):
    """Runs of frequencies, one of them negative, add up."""
    return _changed(spark, sf_dir).hash_factors().select("hash", F.round("factor", 6).alias("factor"))


@query(f"WITH {_NEWSTREAM}, d AS (SELECT t, count(*) AS df FROM (SELECT DISTINCT source, unnest(tokens) AS t FROM now_) GROUP BY 1), m AS (SELECT count(*) AS n FROM now_) SELECT t AS token, df::BIGINT AS df, round(ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE, 6) AS idf FROM d, m")
def library_changed_token_idf(spark, sf_dir):
    return _changed(spark, sf_dir).token_idf().select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_FTOK}, {WINDOWS}, asked_ AS (SELECT DISTINCT query_id, hash FROM q) SELECT query_id, source, hash, start_ms FROM asked_ JOIN ffp USING (hash) WHERE media_id % 5 <> 0")
def library_lookup(spark, sf_dir):
    """Probes of the index on disk, by slots of the hash."""
    library = _changed(spark, sf_dir)
    found = L.lookup(library.table("fingerprints", slot=True), _query(spark, sf_dir))
    return found.join(library.table("media").select("media_id", "source"), "media_id").select("query_id", "source", "hash", "start_ms")


@query("SELECT doc_id AS media_id, 'doc ' || doc_id AS title, CASE WHEN regexp_matches(source, '[0-9]+$') THEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) + 1 ELSE 1 END AS season, CAST(doc_id % 100 + 1 AS INTEGER) AS episode, row_number() OVER (ORDER BY 'doc ' || doc_id) AS place FROM documents")
def media_list(spark, sf_dir):
    """The order of ``list_media`` as a place."""
    listed = _media(spark, sf_dir).select("media_id", "title", "season", "episode")
    return L.in_order(listed, [F.asc_nulls_first("title"), F.asc_nulls_first("season"), F.asc_nulls_first("episode")], "place")


@query("SELECT doc_id AS media_id, 'doc 7' AS title, lang AS language FROM documents WHERE doc_id = 7")
def media_by_id(spark, sf_dir):
    return L.media_info(_media(spark, sf_dir), 7).select("media_id", "title", "language")


@query(f"WITH tok AS (SELECT {_words('line')} AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id = 7)) SELECT hash FROM ({_shingles('tok', 'w')})")
def media_hashes(spark, sf_dir):
    return L.media_hashes(_fingerprints(spark, sf_dir), 7)


@query(f"WITH {_LCS} SELECT media_id, CASE WHEN q.query_id IS NULL THEN md5(array_to_string(stream.tokens, ' ')) ELSE md5(array_to_string(q.tokens, ' ')) END AS stream FROM stream FULL JOIN (SELECT * FROM asked WHERE len(tokens) > 0 AND query_id % 3 > 0) q ON q.query_id = media_id WHERE media_id IS NOT NULL UNION ALL SELECT query_id, md5(array_to_string(tokens, ' ')) FROM asked WHERE len(tokens) > 0 AND query_id % 3 > 0 AND query_id NOT IN (SELECT media_id FROM stream)")
def replaced_streams(spark, sf_dir):
    """Items take the place of the documents of their number; empty ones change nothing."""
    new = _transcripts(spark, sf_dir).select(F.col("query_id").alias("media_id"), F.when(F.col("query_id") % 3 > 0, F.col("tokens")).otherwise(F.array().cast("array<string>")).alias("tokens")).withColumn("starts", F.transform("tokens", lambda t: F.lit(0).cast("long")))
    return L.replace_streams(_streams(spark, sf_dir), new).select("media_id", F.md5(F.array_join("tokens", " ")).alias("stream"))


@query("SELECT doc_id AS media_id, CASE WHEN doc_id = 7 THEN 'new' ELSE 'doc ' || doc_id END AS title, CASE WHEN doc_id = 7 THEN NULL ELSE 'subtitle' END AS duration_source FROM documents")
def updated_media(spark, sf_dir):
    return L.update_media(_media(spark, sf_dir), 7, title="new", duration_source=None).select("media_id", "title", "duration_source")


@query("SELECT doc_id AS media_id, nullif(doc_id % 3, 0)::INTEGER AS season, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 4 * 60)::INTEGER END AS duration_seconds, CASE WHEN doc_id % 4 > 0 THEN 'manual' END AS duration_source FROM documents")
def edited_media(spark, sf_dir):
    form = _media(spark, sf_dir).withColumns({"season": (F.col("media_id") % 3).cast("int"), "year": F.lit(0), "minutes": (F.col("media_id") % 4).cast("int")})
    return L.edited(form).select("media_id", "season", "duration_seconds", "duration_source")


# -- text -------------------------------------------------------------------------------


@query("SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN ' (' || (1950 + doc_id % 60) || ')' ELSE '' END || CASE WHEN doc_id % 4 = 3 OR doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN ' E' || lpad(CAST(doc_id % 90 AS VARCHAR), 2, '0') ELSE ' S03E' || lpad(CAST(doc_id % 90 AS VARCHAR), 2, '0') END AS label FROM documents")
def media_labels(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").selectExpr("doc_id", "source", "CASE WHEN doc_id % 3 = 0 THEN CAST(1950 + doc_id % 60 AS INT) END AS y", "CASE WHEN doc_id % 7 > 0 THEN 3 END AS s", "CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 90 AS INT) END AS e", "CASE WHEN doc_id % 4 = 3 THEN 'movie' ELSE 'tv' END AS k")
    return docs.select("doc_id", T.media_label(F.col("source"), F.col("y"), F.col("s"), F.col("e"), F.col("k")).alias("label"))


#: Titles from the words of documents: the first two, their number, and the length of the text.
_HEADS = f"h AS (SELECT doc_id, array_to_string(w[1:2], ' ') AS head, len(w) AS n, n_chars FROM (SELECT doc_id, n_chars, {_words('text')} AS w FROM documents))"


def _heads(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", T.tokenize(F.col("text")).alias("w"))
    return docs.select("doc_id", F.array_join(F.slice("w", 1, 2), " ").alias("head"), F.size("w").alias("n"), "n_chars")


_ASKED = "CASE n % 3 WHEN 0 THEN head WHEN 1 THEN head || ' ' || (1850 + n_chars % 250) ELSE (1950 + n_chars % 120) || ' ' || head || ' 1986' END"


@query(f"WITH {_HEADS}, q AS (SELECT doc_id, {_ASKED} AS q FROM h) SELECT doc_id, trim(regexp_replace(q, '(19|20)\\d{{2}}', '')) AS title, TRY_CAST(regexp_extract(q, '(19|20)\\d{{2}}') AS INTEGER) AS year FROM q")
def parsed_queries(spark, sf_dir):
    asked = _heads(spark, sf_dir).selectExpr("doc_id", f"{_ASKED} AS q")
    return asked.select("doc_id", T.parse_query(F.col("q")).alias("q")).select("doc_id", "q.title", "q.year")


_SHOWS = "CASE n % 4 WHEN 0 THEN '(' || (1900 + n_chars % 200) || ')' WHEN 1 THEN head || '   (' || (1850 + n_chars % 250) || ')' WHEN 2 THEN ' ' || head || ' (' || (n_chars % 100) || ')' ELSE '(1986) ' || head || ' (2001)  ' || n END"


@query(f"WITH {_HEADS}, s AS (SELECT doc_id, {_SHOWS} AS name FROM h), b AS (SELECT *, trim(regexp_replace(regexp_replace(name, '\\((?:19|20)\\d{{2}}\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS bare FROM s) SELECT doc_id, CASE WHEN bare = '' THEN name ELSE bare END AS show FROM b")
def show_names(spark, sf_dir):
    named = _heads(spark, sf_dir).selectExpr("doc_id", f"{_SHOWS} AS name")
    return named.select("doc_id", T.normalise_show(F.col("name")).alias("show"))


_ONE = "CASE n_chars % 3 WHEN 0 THEN head || ' Part ' || (n_chars % 5 + 1) WHEN 1 THEN head || ' (' || (n_chars % 5 + 1) || ')' ELSE ' ' || head || ' - Pt. IV' END"
_TWO = "CASE n % 4 WHEN 0 THEN head || ' PART ' || (n % 5 + 1) WHEN 1 THEN head || ', pt ii' WHEN 2 THEN head || ' (0' || (n_chars % 5 + 1) || ') ' ELSE 'the ' || head || ' Part ' || (n_chars % 5 + 1) END"


@query(f"WITH {_HEADS}, t AS (SELECT doc_id, trim({_ONE}) AS a, trim({_TWO}) AS b FROM h) SELECT doc_id, lower(a) = lower(b) OR {_part('a')} = {_part('b')} AS same FROM t")
def same_titles(spark, sf_dir):
    pairs = _heads(spark, sf_dir).selectExpr("doc_id", f"{_ONE} AS a", f"{_TWO} AS b")
    return pairs.select("doc_id", T.same_title(F.col("a"), F.col("b")).alias("same"))


@query("SELECT doc_id, source || '.en' AS stem, '.SRT' AS ext, source || '.en.SRT' AS base FROM documents")
def path_parts(spark, sf_dir):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/a.b/c d/"), "source", F.lit(".en.SRT"))).otherwise(F.concat(F.lit("C:\\x\\y.z\\"), "source", F.lit(".en.SRT")))
    return read_table(spark, sf_dir, "documents").select("doc_id", T.stem(name).alias("stem"), T.extension(name).alias("ext"), T.base_name(name).alias("base"))


_FREQUENT = {"en": "the and of to is that it was", "es": "el los las que una por con para", "fr": "le les des est dans une pour vous", "de": "der die das und ist nicht ein zu"}
_VOTES = ", ".join(f"{{'n': len(list_filter(w, lambda x: x IN ({', '.join(repr(y) for y in words.split())}))), 'code': '{code}'}}" for code, words in _FREQUENT.items())


@query(f"WITH w AS (SELECT doc_id, length(trim(text)) AS size, string_split_regex(lower(text), '[^\\pL]+') AS w FROM documents), v AS (SELECT doc_id, size, unnest([{_VOTES}]) AS v FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v.n DESC, v.code DESC) AS k FROM v) SELECT doc_id, CASE WHEN size < 40 OR v.n = 0 THEN NULL ELSE v.code END AS language FROM r WHERE k = 1")
def voted_languages(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", T.vote_language(F.col("text")).alias("language"))


_LETTERS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\pL]+'), lambda x: x <> '')"


@query(
    f"""WITH w AS MATERIALIZED (SELECT doc_id, any_value(lang) AS lang, word, count(*) AS c FROM (SELECT doc_id, lang, unnest({_LETTERS}) AS word FROM documents) GROUP BY doc_id, word),
v AS MATERIALIZED (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: substring(' ' || word || ' ', i, 3))) AS gram FROM (SELECT DISTINCT word FROM w)),
lw AS (SELECT lang, word, sum(c) AS c FROM w WHERE lang IS NOT NULL GROUP BY 1, 2),
n AS MATERIALIZED (SELECT lang, gram, sum(c) AS c FROM lw JOIN v USING (word) GROUP BY 1, 2), t AS MATERIALIZED (SELECT lang, sum(c) AS n FROM n GROUP BY 1),
g AS (SELECT gram FROM n GROUP BY 1 ORDER BY sum(c) DESC, gram LIMIT {LM.MOST_GRAMS}),
m AS MATERIALIZED (SELECT gram, t.lang, ln((coalesce(n.c, 0) + {LM.PSEUDO}::DOUBLE) / (t.n + {LM.PSEUDO}::DOUBLE * {LM.MOST_GRAMS})) AS weight FROM g CROSS JOIN t LEFT JOIN n USING (gram, lang)),
s AS MATERIALIZED (SELECT word, lang, sum(weight) AS s FROM v JOIN m USING (gram) GROUP BY 1, 2),
d AS (SELECT doc_id, s.lang, round(sum(c * s), 6) AS s FROM w JOIN s USING (word) GROUP BY 1, 2),
b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS k FROM d)
SELECT doc_id, CASE WHEN length(trim(text)) >= 40 THEN b.lang END AS language FROM documents LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (doc_id)"""
)
def detected_languages(spark, sf_dir):
    """By a model of trigrams that the labelled documents teach."""
    model = LM.train(read_table(spark, sf_dir, "documents").select("lang", "text"))
    return LM.detect(deal_table(spark, sf_dir, "documents", "doc_id", "text"), model, "doc_id")


_PLAIN = "[abefiknoquv]+"


def _plain_key(word: str) -> str:
    """SQL of the key of a word whose letters have one sound each."""
    start = f"regexp_replace(regexp_replace({word}, '^kn', 'n'), '^[aeiou]', 'A')"
    for letters, sound in (("bb|b", "P"), ("kk|k|qq|q", "K"), ("nn|n", "N"), ("ff|f|vv|v", "F"), ("[aeiou]", "")):
        start = f"regexp_replace({start}, '{letters}', '{sound}', 'g')"
    return start


@query(f"SELECT word, {_plain_key('word')} AS code FROM (SELECT DISTINCT unnest({_words('text')}) AS word FROM documents) WHERE regexp_full_match(word, '{_PLAIN}')")
def phonetic_plain_words(spark, sf_dir):
    """Keys of the words of all documents whose letters have one sound each, which SQL can
    follow; published keys of other words are in the tests."""
    words = read_table(spark, sf_dir, "documents").select(F.explode(T.tokenize(F.col("text"))).alias("word"))
    return encode_vocabulary(words.where(F.col("word").rlike(f"^{_PLAIN}$")))


@query(
    f"""WITH d AS (SELECT doc_id, lang, {_words('text')} AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(CASE WHEN lang <> 'en' THEN w ELSE list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '{_PLAIN}') THEN {_plain_key('x')} ELSE '*' END) END, ' ')) AS stream FROM d"""
)
def phonetic_streams(spark, sf_dir):
    """A key for each word of English, the words of other languages. Keys that SQL can't
    follow (``_PLAIN``) count as a star here."""
    docs = read_table(spark, sf_dir, "documents").withColumns({"words": FP.text_tokens(F.col("text")), "english": T.uses_phonetics(F.col("lang"))})
    docs = docs.withColumn("tokens", phonetic_tokens(F.col("words"), F.col("english")))
    shown = F.when(F.col("english"), F.zip_with("words", "tokens", lambda w, k: F.when(w.rlike(f"^{_PLAIN}$"), k).otherwise("*"))).otherwise(F.col("tokens"))
    return docs.select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join(shown, " ")).alias("stream"))


# -- candidates, cascade, reports -------------------------------------------------------


def _scope(spark, sf_dir):
    """Even queries have the good documents as candidates; odd ones none, which widens."""
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("media_id"))
    return read_table(spark, sf_dir, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("query_id")).join(F.broadcast(good), F.lit(True))


_IN_SCOPE = "(query_id % 2 = 1 OR media_id IN (SELECT doc_id FROM labels WHERE quality = 1))"


@query(
    f"""WITH {_LCS}, sc AS (SELECT * EXCLUDE rank, row_number() OVER (PARTITION BY query_id ORDER BY round(confidence, 9) DESC, match_count DESC, media_id) AS rank FROM top WHERE {_IN_SCOPE}),
f AS (SELECT * FROM sc WHERE rank <= 5 AND query_count >= 8 AND confidence >= 0.45),
g AS (SELECT *, max(CASE WHEN rank = 1 THEN confidence END) OVER (PARTITION BY query_id) - max(CASE WHEN rank = 2 THEN confidence END) OVER (PARTITION BY query_id) AS gap FROM f)
SELECT query_id, media_id, round(confidence, 6) AS confidence, rank FROM g WHERE gap IS NULL OR gap >= 0.12"""
)
def fuzzy_stage_scoped(spark, sf_dir):
    found = S.fuzzy_stage(_transcripts(spark, sf_dir), _streams(spark, sf_dir), scope=_scope(spark, sf_dir))
    return found.select("query_id", "media_id", F.round("confidence", 6).alias("confidence"), F.col("rank").cast("long").alias("rank"))


_GOOD = _DICE.replace("SELECT DISTINCT media_id, unnest(tokens) AS t FROM stream", "SELECT DISTINCT media_id, unnest(tokens) AS t FROM good").replace("(SELECT count(*) FROM stream)", "(SELECT count(*) FROM good)").replace("unnest(range(1, len(tokens))) AS i FROM stream", "unnest(range(1, len(tokens))) AS i FROM good").replace(", t AS (", ", good AS (SELECT * FROM stream WHERE media_id IN (SELECT doc_id FROM labels WHERE quality = 1)), t AS (", 1)


_SETS = """r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(confidence, 9) DESC, match_count DESC, media_id) AS rank FROM dice WHERE query_id IN (SELECT query_id FROM asked WHERE len(tokens) >= 4)),
g AS (SELECT *, max(confidence) OVER (PARTITION BY query_id) AS best, max(CASE WHEN rank = 1 THEN confidence END) OVER (PARTITION BY query_id) - max(CASE WHEN rank = 2 THEN confidence END) OVER (PARTITION BY query_id) AS gap FROM r)
SELECT query_id, media_id, round(confidence, 6) AS confidence, match_count, rank FROM g WHERE rank <= 5 AND best >= 0.2 AND (gap IS NULL OR gap >= 0.05)"""


@query(f"SELECT * FROM (WITH {_GOOD}, {_SETS} AND query_id % 2 = 0) UNION ALL SELECT * FROM (WITH {_DICE}, {_SETS} AND query_id % 2 = 1)")
def ngram_stage_scoped(spark, sf_dir):
    """The idf of a query with candidates is over these, that of others over all."""
    found = S.ngram_stage(_transcripts(spark, sf_dir), _streams(spark, sf_dir), scope=_scope(spark, sf_dir), idf=_token_idf(spark, sf_dir))
    return found.select("query_id", "media_id", F.round("confidence", 6).alias("confidence"), "match_count", F.col("rank").cast("long").alias("rank"))


_LEAD = "SELECT doc_id AS query_id, doc_id * 10 + {k} AS media_id, round(((doc_id * {m}) % 97) / 100.0::DOUBLE, 4) AS confidence, doc_id % 20 AS match_count, CASE WHEN doc_id % {m} = 0 THEN 'note {k}' ELSE '' END AS boost_notes, CASE WHEN doc_id % 5 > 0 THEN round((doc_id % 9) / 100.0::DOUBLE, 4) END AS margin FROM documents WHERE doc_id % {m} <> 1"


@query(
    f"""WITH x AS ({_LEAD.format(k=1, m=3)}), y AS ({_LEAD.format(k=2, m=5)}), z AS ({_LEAD.format(k=3, m=7)}),
e AS (SELECT *, 'phonetic' AS method FROM x UNION ALL SELECT query_id, media_id, confidence, match_count, boost_notes, NULL, 'fuzzy' FROM y WHERE query_id NOT IN (SELECT query_id FROM x)),
j AS (SELECT coalesce(e.query_id, z.query_id) AS query_id, e.* EXCLUDE query_id, z.media_id AS lm, z.confidence AS lc, z.match_count AS ln, z.boost_notes AS lb, z.margin AS lg,
  z.query_id IS NOT NULL AND (e.query_id IS NULL OR e.confidence < 0.4 AND round(z.confidence - 0.1::DOUBLE, 4) > e.confidence) AS t FROM e FULL JOIN z ON e.query_id = z.query_id)
SELECT query_id, CASE WHEN t THEN lm ELSE media_id END AS media_id, CASE WHEN t THEN lc ELSE confidence END AS confidence, CASE WHEN t THEN ln ELSE match_count END AS match_count, CASE WHEN t THEN lb ELSE boost_notes END AS boost_notes,
  CASE WHEN t THEN 'ngram' ELSE method END AS method, CASE WHEN t THEN coalesce(lg, margin) ELSE margin END AS margin, CASE WHEN t THEN nullif(boost_notes, '') END AS early_notes FROM j"""
)
def stage_cascade(spark, sf_dir):
    """Leaders of made-up stages; those of the last have a raw confidence 0.1 lower."""
    docs = read_table(spark, sf_dir, "documents")

    def lead(k: int, m: int) -> DataFrame:
        return docs.where(f"doc_id % {m} <> 1").selectExpr("doc_id AS query_id", f"doc_id * 10 + {k} AS media_id", f"round(((doc_id * {m}) % 97) / 100.0D, 4) AS confidence", "doc_id % 20 AS match_count", f"CASE WHEN doc_id % {m} = 0 THEN 'note {k}' ELSE '' END AS boost_notes", "CASE WHEN doc_id % 5 > 0 THEN round((doc_id % 9) / 100.0D, 4) END AS margin")

    return V.cascade(lead(1, 3), lead(2, 5), lead(3, 7).withColumn("raw", F.round(F.col("confidence") - 0.1, 4)))


_NOTES = """, w AS (SELECT *, CASE WHEN NOT none AND rel > 0.15 THEN round_even(rel * 100, 0)::BIGINT END AS gone, NOT (none OR low OR unclear) AS sure, abs(duration_s / 60 - expected) > 4 AS late
  FROM (SELECT v.*, {expected} AS expected FROM v))
SELECT query_id, concat_ws('; ', CASE WHEN none THEN 'no match' END, CASE WHEN low THEN 'low confidence ' || round_even(confidence * 100, 0)::BIGINT || '%' END, CASE WHEN unclear THEN 'ambiguous: runner-up within ' || round_even(margin * 100, 0)::BIGINT || '%' END,
  CASE WHEN late THEN 'runtime ' || round_even(duration_s / 60, 0)::BIGINT || 'm vs expected ' || expected || 'm' END,
  CASE WHEN gone IS NULL THEN NULL WHEN manual AND NOT sure THEN 'duration mismatch: file is ' || round_even(duration_s / 60, 0)::BIGINT || 'm, episode should be ~' || round_even(duration_seconds / 60.0::DOUBLE, 0)::BIGINT || 'm (' || gone || '% off)'
    WHEN manual THEN 'length differs: file is ' || round_even(duration_s / 60, 0)::BIGINT || 'm vs listed ~' || round_even(duration_seconds / 60.0::DOUBLE, 0)::BIGINT || 'm (' || gone || '% off)'
    ELSE 'approx duration off ~' || gone || '% (subtitle estimate ~' || round_even(duration_seconds / 60.0::DOUBLE, 0)::BIGINT || 'm)' END,
  CASE WHEN status = 'rename' THEN 'named ' || own || ' but matches ' || id END) AS notes, review AS needs_review FROM w"""


@query(f"WITH {_VERDICT}{_NOTES.format(expected='NULL::DOUBLE')}")
def verdict_notes(spark, sf_dir):
    return _results(spark, sf_dir).select("query_id", "notes", "needs_review")


@query(f"WITH {_VERDICT}{_NOTES.format(expected='CASE WHEN media_id % 8 <> 0 THEN (5 + media_id % 8)::DOUBLE END')}")
def runtime_check(spark, sf_dir):
    """Expected runtimes by episode, for those whose number isn't one."""
    runtimes = spark.createDataFrame([(f"s0{s}e0{k + 1}", 5.0 + k) for s in range(1, 5) for k in range(1, 8)], "episode_id string, minutes double")
    return _results(spark, sf_dir, runtimes).select("query_id", "notes", "needs_review")


_ROW = "SELECT 'Show.' || own || '.mkv' AS filename, CASE WHEN none THEN 'UNKNOWN' ELSE id END AS episode_id, CASE WHEN none THEN '' ELSE 'Part ' || (media_id % 7) END AS episode_title, round(coalesce(confidence, 0), 4)::DOUBLE AS confidence, CASE WHEN none THEN '0/0' ELSE '3/5' END AS agreement, CASE WHEN none THEN 'none' ELSE 'phonetic' END AS method, status AS name_status, review AS needs_review, round(duration_s, 1) AS duration_s FROM v"
_REPORT = ["filename", "episode_id", "episode_title", "confidence", "agreement", "method", "name_status", "needs_review", "duration_s"]


def _voted(spark, sf_dir):
    return _results(spark, sf_dir).withColumns({"votes": F.when(F.col("episode_id").isNotNull(), 3), "total_samples": F.when(F.col("episode_id").isNotNull(), 5)})


@query(f"WITH {_VERDICT} {_ROW}")
def csv_report(spark, sf_dir):
    """Written and read again; CSV has no types, so they are given back."""
    path = scratch_dir(spark)
    sinks.write_csv(_voted(spark, sf_dir), path)
    back = spark.read.csv(path, header=True)
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "episode_title" else F.col(c).cast({"confidence": "double", "needs_review": "boolean", "duration_s": "double"}.get(c, "string")).alias(c) for c in _REPORT])


@query(f"WITH {_VERDICT} {_ROW}")
def json_report(spark, sf_dir):
    path = scratch_dir(spark)
    sinks.write_json(_voted(spark, sf_dir), path)
    return spark.read.json(path).select(*_REPORT)


@query(f"WITH {_VERDICT} SELECT query_id FROM v WHERE NOT none AND (review OR status = 'unknown') AND (contains(lower('Show.' || own || '.mkv ' || id || ' Part ' || (media_id % 7)), 'e03 part 2') OR contains((SELECT lower(source || ' - ' || id || ' - Part ' || (media_id % 7) || '.mkv') FROM documents WHERE doc_id = media_id), 'e03 part 2'))")
def found_results(spark, sf_dir):
    return V.find_results(_results(spark, sf_dir), " E03 Part 2", "Review").select("query_id")


@query(f"WITH {_VERDICT} SELECT query_id, row_number() OVER (ORDER BY CASE WHEN none THEN -1 ELSE media_id % 4 + 1 END DESC, CASE WHEN none THEN -1 ELSE media_id % 8 + 1 END DESC, query_id) AS place FROM v")
def sorted_results(spark, sf_dir):
    """The place of each row in the order, counted by ranges."""
    results = _results(spark, sf_dir)
    return L.in_order(results, V.sort_order(results, "episode_id", ascending=False), "place").select("query_id", F.col("place").cast("long").alias("place"))


_KNOWN = "CASE n_chars % 4 WHEN 0 THEN 'the case ' || lang WHEN 1 THEN 'THE JUDGE' WHEN 2 THEN 'Double ' || source ELSE '  ' END"


@query(f"WITH {_PARSED}, t AS (SELECT doc_id, episode_title AS own, trim({_KNOWN}) AS title FROM p JOIN documents USING (doc_id)) SELECT doc_id, coalesce(own IS NOT NULL AND title <> '' AND NOT (lower(own) = lower(title) OR {_part('own')} = {_part('title')}), false) AS mismatch FROM t")
def title_mismatches(spark, sf_dir):
    """The title in a file's name against the one that is known, of each document."""
    known = read_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_NAMES} AS name", f"{_KNOWN} AS title")
    return known.select("doc_id", V.title_mismatch(F.col("name"), F.col("title")).alias("mismatch"))
