"""Build a library from subtitle files and identify noisy transcripts, end to end."""

import pytest

from lexitrace.operators.identify import Library

COURT = ["the prosecution would like to call the first witness", "objection your honour that is hearsay", "the night of the murder my client was at the harbour", "please tell the court what you saw that night", "I saw a man running from the old lighthouse", "the defence rests its case your honour", "ladies and gentlemen of the jury you have heard the evidence"]
SHIP = ["the captain ordered the crew to raise the sails", "a storm was coming from the western islands", "we found gold in the belly of the sunken ship", "nobody leaves this island before sunrise", "the lighthouse keeper told us to turn around", "bring the map and the compass to my cabin", "there is water in the lower deck captain"]


def srt(lines):
    return "\n\n".join(f"{k}\n00:00:{4 * k:02d},000 --> 00:00:{4 * k + 3:02d},000\n{x}" for k, x in enumerate(lines, 1))


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("subs")
    (folder / "Lanterns.S01E01.The.Trial.en.srt").write_text(srt(COURT))
    (folder / "Voyage.S02E05.Storm.srt").write_text(srt(SHIP))
    out = Library(spark, f"file://{tmp_path_factory.mktemp('lib')}/l")
    first = out.build(str(folder))
    assert first["files"] == 2 and first["skipped"] == 0 and first["fingerprints"] > 50
    (folder / "Voyage.S02E06.srt").write_text(srt(["gold and silver coins everywhere", "the ship is lost captain"]))
    again = out.build(str(folder))
    assert (again["files"], again["skipped"]) == (1, 2)
    return out


def test_tables(library):
    media = {r.source: r for r in library.table("media").collect()}
    assert sorted(r.media_id for r in media.values()) == [1, 2, 3]
    first = media["Lanterns.S01E01.The.Trial.en.srt"]
    assert (first.title, first.season, first.episode, first.episode_title, first.language, first.duration_seconds) == ("Lanterns", 1, 1, "The Trial", "en", 31)
    assert library.table("streams").count() == 3
    assert library.table("fingerprints").select("media_id").distinct().count() == 3


def test_verdicts(spark, library):
    noisy = "the prosecution would like to call the furst witness objektion your honor that is hearsay"
    rows = [
        (1, "rip_a.mkv", 0, 10.0, 31.0, noisy, "Lanterns"),
        (1, "rip_a.mkv", 1, 20.0, 31.0, "i saw a man running from the old light house the defense rests its case", "Lanterns"),
        (2, "Voyage.S02E05.mkv", 0, 10.0, 31.0, "we found gold in the belly of the sunken ship nobody leaves this island before sunrise", None),
        (3, "x.mkv", 0, 10.0, 31.0, "add two cups of flour and stir the butter slowly", None),
        (4, "empty.mkv", 0, 10.0, 31.0, "", None),
    ]
    asked = spark.createDataFrame(rows, "query_id long, filename string, part int, start_s double, duration_s double, text string, expected_show string")
    got = {r.query_id: r for r in library.identify(asked).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1].episode_id, got[1].needs_review, got[1].name_status) == ("S01E01", False, "rename") and got[1].confidence > 0.5
    assert got[1].suggested_filename == "Lanterns - S01E01 - The Trial.mkv" and "show match +15%" in got[1].notes
    assert (got[2].episode_id, got[2].name_status) == ("S02E05", "correct")
    assert got[3].needs_review and (got[3].episode_id is None or got[3].confidence < 0.4)
    assert got[4].episode_id is None and got[4].notes == "no speech recognised"
