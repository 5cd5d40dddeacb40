import json

import pytest
from pyspark.sql import functions as F

from lexitrace.operators import fingerprint as FP
from lexitrace.operators import library as L
from lexitrace.sources import sinks
from lexitrace.sources import subtitles as SRC
from lexitrace.streaming.ingest import ingest

SRT = "﻿1\r\n00:00:02,000 --> 00:00:05,500\r\nThe judge entered\r\nthe court today.\r\n\r\n2\r\n00:01:00,000 --> 00:01:05,000\r\n \r\n\r\n3\r\n00:01:06,000 --> 00:01:07,25\r\nOrder in this court!\r\n"
VTT = "WEBVTT\n\nNOTE x\n\n00:02.000 --> 00:05.000 align:start\nHello there\n\nintro\n01:00:00.000 --> 01:00:01.000\nAgain\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.srt").write_bytes(SRT.encode())
    (tmp_path / "a" / "b" / "TWO.VTT").write_text(VTT)
    (tmp_path / "latin.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\ncafé\n".encode("latin-1"))
    (tmp_path / "film.mkv").write_bytes(b"x")
    (tmp_path / "a" / "b" / "deep.MP4").write_bytes(b"x")
    return tmp_path


def test_subtitles(spark, folder):
    cues = {}
    for r in SRC.read_subtitles(spark, str(folder)).orderBy("source", "pos").collect():
        cues.setdefault(r.source.rsplit("/", 1)[1], []).append((r.start_ms, r.end_ms, r.text))
    assert cues["one.srt"] == [(2000, 5500, "The judge entered the court today."), (66000, 67250, "Order in this court!")]
    assert cues["TWO.VTT"] == [(2000, 5000, "Hello there"), (3600000, 3601000, "Again")]
    assert cues["latin.srt"] == [(1000, 2000, "café")]


def test_other_formats_are_refused(spark):
    with pytest.raises(Exception, match="not a subtitle format"):
        SRC.parse_cues(spark.createDataFrame([("a.txt", "x")], "source string, content string")).collect()


def test_discovery(spark, folder):
    names = lambda **k: [r.path.rsplit("/", 1)[1] for r in SRC.discover_media(spark, str(folder), **k).collect()]
    assert sorted(names()) == ["deep.MP4", "film.mkv"] and names(depth=0) == ["film.mkv"] and names(extensions="mp4") == ["deep.MP4"]
    assert SRC.parse_extensions("mp4, mkv;.AVI") == [".avi", ".mkv", ".mp4"] and SRC.parse_extensions("") == SRC.MEDIA_EXTENSIONS


def test_runtimes(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"S01E01": 74, "S01E03": 48.5}')
    assert {r.episode_id: r.minutes for r in SRC.read_runtimes(spark, str(tmp_path / "r.json")).collect()} == {"S01E01": 74.0, "S01E03": 48.5}


def cues(spark):
    rows = [(1, 0, 0, 2000, "the judge entered the court"), (1, 1, 3000, 5000, "the judge entered the room"), (2, 0, 0, 65000, "x"), (3, 0, 200000, 210000, None)]
    return spark.createDataFrame(rows, "media_id long, pos int, start_ms long, end_ms long, text string")


def media(spark, rows):
    return spark.createDataFrame(rows, L.MEDIA)


ROW = (1, "T", None, "tv", 1, None, "a.srt", None, None, 60, "subtitle", None)


def test_fingerprints_stay_in_cues(spark):
    fp = FP.library_fingerprints(FP.cue_tokens(cues(spark)))
    assert {(r.media_id, r.n_fingerprints) for r in L.media_counts(fp).collect()} == {(1, 12)}
    assert L.document_frequency(fp).count() == 9  # "the judge entered (the)" twice
    s = {r.media_id: (r.tokens, r.starts) for r in FP.token_streams(FP.cue_tokens(cues(spark))).collect()}
    assert list(s) == [1] and s[1][0][:3] == ["the", "judge", "entered"] and s[1][1] == [0] * 5 + [3000] * 5


def test_lookup_and_scope(spark):
    fp = FP.library_fingerprints(FP.cue_tokens(cues(spark)))
    q = fp.select(F.lit(7).alias("query_id"), "hash")
    assert L.lookup(fp, q).count() == 12
    empty = spark.createDataFrame([], "media_id long")
    assert L.lookup(fp, q, empty).count() == 0 and L.scoped_count(fp, empty).first()[0] == 0 and L.scoped_count(fp).first()[0] == 12


def test_resolve_is_null_safe(spark):
    m = media(spark, [ROW, (2, "T", None, "tv", None, None, "b", *ROW[7:]), (3, "T", 1, "tv", None, None, "c", *ROW[7:])])
    want = spark.createDataFrame([("T", None, None), ("T", None, None)], "title string, season int, episode int")
    assert sorted(r.media_id for r in L.resolve_episodes(m, want).collect()) == [2, 3]


def test_upsert(spark):
    old = media(spark, [ROW, (4, "U", 2000, "tv", 1, 1, "b", "show", None, 60, None, "en")])
    new = old.drop("media_id").limit(0).unionByName(spark.createDataFrame([("T", -1, "tv", 1, None, "a.srt", "Show", None, None, None, "en"), ("U", 2000, "tv", 1, 1, "b", None, "E", 90, "manual", None), ("N", None, "tv", 1, 1, "n", None, None, None, None, None), ("M", None, "tv", 1, 1, "n", None, None, None, None, None)], ", ".join(L.MEDIA.split(", ")[1:])))
    got = {r.media_id: r for r in L.upsert(old, new).collect()}
    assert sorted(got) == [1, 4, 5, 6]
    assert (got[1].show_title, got[1].duration_seconds, got[1].language) == ("Show", 60, "en")
    assert (got[4].show_title, got[4].episode_title, got[4].duration_seconds, got[4].language) == ("show", "E", 90, "en")
    assert (got[5].title, got[6].title) == ("M", "N")


def test_changes(spark):
    m = media(spark, [ROW, (2, "U", 2000, "tv", 1, 1, "b", "show", None, 60, None, "en")])
    assert L.update_media(m, 2, title="V", year=None).where("media_id = 2").first()[1:3] == ("V", None)
    with pytest.raises(ValueError):
        L.update_media(m, 2, nonsense=1)
    gone = m.where("media_id = 1")
    assert [t.count() for t in L.delete_media(gone, m, FP.library_fingerprints(FP.cue_tokens(cues(spark))))] == [1, 0]
    assert L.migrate(m.select("media_id", "title")).columns == m.columns
    fp = FP.library_fingerprints(FP.cue_tokens(cues(spark)))
    assert [r.n_fingerprints for r in L.listing(m, fp).orderBy("media_id").collect()] == [12, 0] and L.listing(m, fp, "SHOW").count() == 1
    assert [r.source for r in L.unprocessed(m.select("source"), m, fp).collect()] == ["b"]
    assert tuple(L.statistics(m, fp).first()) == (2, 12)
    e = L.edited(m.withColumn("minutes", F.lit(0))).first()
    assert e.duration_seconds is None and e.duration_source is None
    s = FP.token_streams(FP.cue_tokens(cues(spark)))
    assert L.replace_streams(s, s.withColumn("tokens", F.array().cast("array<string>"))).first().tokens == s.first().tokens


def test_runtime_of_subtitles(spark):
    got = {r.media_id: r for r in L.subtitle_runtime(cues(spark)).collect()}
    assert (got[2].seconds, got[2].confidence) == (65, "low") and got[1].seconds == 5 and got[1].confidence == "high"
    gap = spark.createDataFrame([(1, 0, 0, 1000, "a " * 500), (1, 1, 130000, 131000, "b " * 500)], "media_id long, pos int, start_ms long, end_ms long, text string")
    assert L.subtitle_runtime(gap).first().confidence == "low"
    m = media(spark, [(1, "T", None, "tv", 1, 2, "a", "Show (1986)", None, 60, "subtitle", None)])
    r = spark.createDataFrame([("show", 1, 2, 48.5)], "show string, season int, episode int, runtime_min double")
    assert L.with_runtimes(m, r).first()[9:11] == (2910, "online")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.mkv", 0.5, 3, 5)], "filename string, confidence double, votes int, total_samples int")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True)
    assert back.columns == sinks.COLUMNS and back.first().agreement == "3/5"
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().filename == "a.mkv"
    history = sinks.RenameHistory(str(tmp_path / "h.json"), most=2)
    for k in range(3):
        history.push(str(k), [{"src": "a", "dest": "b"}])
    assert [b["destination"] for b in history.batches()] == ["1", "2"] and history.pop()["destination"] == "2" and history.peek()["destination"] == "1"
    (tmp_path / "h.json").write_text("broken")
    assert history.batches() == [] and history.pop() is None and json.loads("[]") == []


def test_streaming_equals_batch(spark, tmp_path):
    cues(spark).where("text IS NOT NULL").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cues(spark).schema).parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "lib"), str(tmp_path / "ck")).awaitTermination(120)
    want = FP.library_fingerprints(FP.cue_tokens(cues(spark)))
    got = spark.read.parquet(str(tmp_path / "lib/fingerprints")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
