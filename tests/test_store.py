"""A library that changes on disk: deletions, edits, streams, concurrent builds, look-ups."""

import threading

import pytest
from pyspark.sql import functions as F

from lexitrace.config import FingerprintConfig
from lexitrace.operators import library as L
from lexitrace.operators import scoring as S
from lexitrace.operators import store
from lexitrace.operators.identify import Library
from lexitrace.streaming import ingest

CONFIG = FingerprintConfig(language="de")


def files(spark, numbers, words=12, show="Show"):
    def srt(k):
        lines = [" ".join(f"w{(k * 7 + c * 3 + j) % 50}" for j in range(words)) for c in range(4)]
        return "\n\n".join(f"{c + 1}\n00:00:{4 * c:02d},000 --> 00:00:{4 * c + 3:02d},000\n{x}" for c, x in enumerate(lines)).encode()

    return spark.createDataFrame([(f"/x/{show}.S01E{k:02d}.srt", bytearray(srt(k))) for k in numbers], "path string, content binary")


def whole(library):
    """Everything that depends on content, by source."""
    source = {r.media_id: r.source for r in library.table("media").collect()}
    prints = sorted((source[r.media_id], r.hash, r.start_ms) for r in library.table("fingerprints").collect())
    streams = sorted((source[r.media_id], tuple(r.tokens)) for r in library.table("streams").collect())
    postings = sorted((source[r.media_id], r.token, r.n) for r in library.table("postings").collect())
    hashes = sorted((r.hash, r.df) for r in library.table("hash_df").collect())
    tokens = sorted((r.token, r.df) for r in library.table("token_df").collect())
    return sorted(source.values()), prints, streams, postings, hashes, tokens


def made(spark, tmp_path, name, *builds):
    library = Library(spark, f"file://{tmp_path}/{name}", CONFIG)
    for numbers in builds:
        library.build(files(spark, numbers))
    return library


def agrees(library):
    """Frequencies and postings on disk are those of the fingerprints and streams."""
    found = {n: {tuple(r) for r in library.table(n).collect()} for n in ("hash_df", "token_df", "postings")}
    assert found["hash_df"] == {tuple(r) for r in L.document_frequency(library.table("fingerprints")).collect()}
    assert found["token_df"] == {tuple(r) for r in S.token_frequency(library.table("streams")).collect()}
    assert found["postings"] == {tuple(r) for r in S.token_postings(library.table("streams")).collect()}


def test_changes_equal_a_fresh_build(spark, tmp_path):
    library = made(spark, tmp_path, "a", list(range(1, 9)), [8, 9])
    parts = {n: [library.parts(n, [p]).count() for p, _ in library.state()[n]] for n in store.Store.SHAPES}
    assert parts["media"] == [8, 1] and all(len(p) == 2 for p in parts.values())
    assert all(parts[n][1] * 4 < parts[n][0] for n in ("fingerprints", "streams", "postings"))  # what it adds
    ids = {r.source[9:11]: r.media_id for r in library.table("media").collect()}
    assert library.delete([ids["02"], ids["09"], 999]) == 2 and library.delete([ids["02"]]) == 0
    want = whole(made(spark, tmp_path, "b", [1, 3, 4, 5, 6, 7, 8]))
    assert whole(library) == want
    known = library.versions()
    library.compact()
    assert whole(library) == want and library.state()["deletes"] == []
    assert {len(library.state()[n]) for n in store.Store.SHAPES} == {1}
    assert library.vacuum(0) > 0 and len(library.versions()) == 1 and library.versions()[0] > known[-1]
    assert whole(library) == want
    # An identifier isn't given again, and a file that was deleted can come back.
    done = library.build(files(spark, [9, 1]))
    assert (done["files"], done["skipped"]) == (1, 1)
    again = {r.source[9:11]: r.media_id for r in library.table("media").collect()}
    assert again["09"] > max(ids.values()) and sorted(again) == ["01", "03", "04", "05", "06", "07", "08", "09"]
    agrees(library)
    library.clear()
    assert whole(library) == ([], [], [], [], [], []) and library.state()["top"] == again["09"]


def test_forced_build_replaces(spark, tmp_path):
    library = made(spark, tmp_path, "f", [1, 2])
    ids = {r.source: r.media_id for r in library.table("media").collect()}
    done = library.build(files(spark, [2], words=6), force=True)
    assert done["files"] == 1 and {r.source: r.media_id for r in library.table("media").collect()} == ids
    counts = {r.media_id: r.n_fingerprints for r in L.media_counts(library.table("fingerprints")).collect()}
    assert sorted(counts.values()) == [4 * 9, 4 * 27]
    agrees(library)
    before = library.versions()
    assert library.build(files(spark, [1, 2]))["files"] == 0 and library.versions() == before


def test_update_and_streams(spark, tmp_path):
    library = made(spark, tmp_path, "u", [1, 2, 3])
    media = {r.source[9:11]: r for r in library.table("media").collect()}
    rows = spark.createDataFrame([(media["02"].media_id, "New", None), (77, "x", None)], "media_id long, title string, duration_seconds int")
    assert library.update(rows) == 1
    now = {r.source[9:11]: r for r in library.table("media").collect()}
    assert (now["02"].title, now["02"].duration_seconds, now["02"].season) == ("New", None, 1) and now["01"] == media["01"]
    with pytest.raises(ValueError):
        library.update(rows.withColumnRenamed("title", "media"))
    streams = spark.createDataFrame([(now["01"].media_id, ["a", "b", "a"], [1, 2, 3]), (now["03"].media_id, [], []), (77, ["x"], [1])], "media_id long, tokens array<string>, starts array<long>")
    assert library.replace_streams(streams) == 1
    tokens = {r.media_id: r.tokens for r in library.table("streams").collect()}
    assert tokens[now["01"].media_id] == ["a", "b", "a"] and len(tokens) == 3 and len(tokens[now["03"].media_id]) == 48
    want = {(r.token, r.df) for r in S.token_frequency(library.table("streams")).collect()}
    assert {(r.token, r.df) for r in library.table("token_df").collect()} == want
    assert {(r.token, r.n) for r in library.table("postings").where(F.col("media_id") == now["01"].media_id).collect()} == {("a", 2), ("b", 1)}


def test_two_builders_lose_nothing(spark, tmp_path):
    path, errors = f"file://{tmp_path}/two", []

    def build(numbers):
        try:
            for k in numbers:
                Library(spark, path, CONFIG).build(files(spark, [k]))
        except Exception as e:  # noqa: BLE001  told to the main thread
            errors.append(e)

    threads = [threading.Thread(target=build, args=(n,)) for n in ([1], [2])]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    library = Library(spark, path, CONFIG)
    ids = [r.media_id for r in library.table("media").collect()]
    assert len(set(ids)) == 2 and len(library.versions()) == 2
    assert len({m for m, _, _ in whole(library)[1]}) == 2
    agrees(library)


def test_a_commit_is_exclusive(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/e", CONFIG)
    mine = library.state()
    mine["version"] += 1
    assert library._commit(mine | {"top": 5}) and not library._commit(mine | {"top": 6})
    assert library.state()["top"] == 5
    calls = []

    def make(state):
        calls.append(state["version"])
        if len(calls) == 1:
            library._commit(state | {"top": 8})
        state["top"] += 1

    library.change(make)
    assert len(calls) == 2 and library.state()["top"] == 9


def test_runs_are_merged_by_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FAN", 2)
    library = Library(spark, f"file://{tmp_path}/r", CONFIG)
    for k in range(5):
        run = spark.createDataFrame([("a", 1), (f"b{k}", 2)] + ([("b1", -2)] if k == 4 else []), "token string, df long")
        library.change(lambda state, run=run: library.add_run(state, "token_df", run))
    assert sorted(level for _, level in library.state()["token_df"]) == [0, 2]
    assert {tuple(r) for r in library.table("token_df").collect()} == {("a", 5), ("b0", 2), ("b2", 2), ("b3", 2), ("b4", 2)}


def test_look_up_reads_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/slots"
    prints = spark.range(40_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("hash"), F.lit(3).alias("shingle_size"), (F.col("id") % 90).alias("media_id"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 5).alias("end_ms"))
    L.write_slotted(prints, "hash", path)
    index = spark.read.parquet(path)
    query = prints.where("start_ms % 100000 = 0").select(F.lit(1).cast("long").alias("query_id"), "hash")
    n_files = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    asked = query.count()
    assert asked == 4
    assert n_files(L.in_slots(index, query)) * 10 < n_files(index)
    got = sorted(map(tuple, L.lookup(index, query).collect()))
    assert got == sorted(map(tuple, L.lookup(prints, query).collect())) and len(got) == asked


def test_a_library_grows_from_a_stream(spark, tmp_path):
    folder = tmp_path / "subs"
    folder.mkdir()
    put = lambda k, words: (folder / f"Show.S01E{k:02d}.srt").write_text(f"1\n00:00:01,000 --> 00:00:03,000\n{words}")
    library = Library(spark, f"file://{tmp_path}/grown", CONFIG)
    run = lambda: ingest.grow(ingest.subtitle_stream(spark, f"file://{folder}"), library, f"file://{tmp_path}/check").awaitTermination()
    put(1, "one two three four five")
    (folder / "Show.S01E09.txt").write_text("no subtitle")
    run()
    put(2, "six seven eight nine")
    run()
    run()
    assert sorted(r.source for r in library.table("media").collect()) == ["Show.S01E01.srt", "Show.S01E02.srt"]
    assert len(library.versions()) == 2 and library.table("fingerprints").count() == 6 + 3
    agrees(library)


def test_paths(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    Library(spark, f"file://{tmp_path}/folder/deep").check_path()
    with pytest.raises(ValueError):
        Library(spark, f"file://{tmp_path}/file").check_path()


def test_places_in_order(spark):
    rows = spark.createDataFrame([(k * 37 % 101, f"x{k}") for k in range(101)], "a long, b string").repartition(7)
    assert sorted((r.a, r.place) for r in L.in_order(rows, [F.asc("a")], "place").collect()) == [(k, k + 1) for k in range(101)]
