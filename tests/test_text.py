import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from lexitrace.functions import text as T
from lexitrace.functions.phonetics import double_metaphone, phonetic_tokens, word_key
from lexitrace.operators import sampling
from lexitrace.plans import queries


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or [F.lit(0).alias("z")]).select(column).first()[0]


def lit(x):
    return F.lit(x).cast("string")


def test_clean_text(spark):
    assert value(spark, T.clean_text(lit("MATLOCK: <i>It's</i> (sighs) well-known [door] {x}  42!"))) == "it's well known 42"
    assert value(spark, T.clean_text(lit(None))) == ""


def test_tokenize(spark):
    assert value(spark, T.tokenize(lit("I saw a 7 the the cat"))) == ["saw", "7", "the", "the", "cat"]
    assert value(spark, T.tokenize(lit("saw the the cat"), drop_stopwords=True)) == ["saw", "cat"]
    assert value(spark, T.tokenize(lit(""))) == []


@pytest.mark.parametrize("name,want", [("Lanterns.S01E04.eng.srt", "Lanterns.S01E04.srt"), ("Show.PT.SRT", "Show.SRT"), ("Movie.2020.mkv", "Movie.2020.mkv")])
def test_strip_language_code(spark, name, want):
    assert value(spark, T.strip_language_code(lit(name))) == want


@pytest.mark.parametrize(
    "name,want",
    [
        ("Lanterns.1x03.The.Ferry.mkv", (1, 3, "The Ferry")),
        ("Lanterns 103.mp4", (1, 3, None)),
        ("Show.S01E01E02.Double.mkv", (1, 1, "Double")),
        ("Lanterns (1986) - S01E04 - The Tide.en.srt", (1, 4, "The Tide")),
        ("Season 2 Episode 5.avi", (2, 5, None)),
        ("Film 1999.mkv", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_parse_episode(spark, name, want):
    assert tuple(value(spark, T.parse_episode(lit(name)))) == want


def test_file_metadata(spark):
    m = value(spark, T.file_metadata(lit("/a/Lanterns.1986.S01E03.The.Ferry.1080p.mkv")))
    assert (m.title, m.year, m.media_type, m.season, m.episode, m.show_title) == ("Lanterns 1986", 1986, "tv", 1, 3, "Lanterns 1986")
    m = value(spark, T.file_metadata(lit("Some Film.mkv")))
    assert (m.title, m.media_type, m.show_title) == ("Some Film", "movie", None)
    assert tuple(value(spark, T.parse_query(lit("Lanterns 1986")))) == ("Lanterns", 1986)


@pytest.mark.parametrize("title", ["The Prisoner (1)", "The Prisoner (Part 1)", "The Prisoner - Part I", "The Prisoner Part 1", "the prisoner pt. 1"])
def test_part_markers(spark, title):
    assert value(spark, T.normalise_part(lit(title))) == "the prisoner part 1"
    assert value(spark, T.same_title(lit(title), lit("THE PRISONER (1)")))


def test_names(spark):
    n = lambda s, e, t="Nowhere To Turn", show="Lanterns": value(spark, T.suggested_name(lit(show), F.lit(s).cast("int"), F.lit(e).cast("int"), lit(t), lit(".mp4")))
    assert n(5, 2) == "Lanterns - S05E02 - Nowhere To Turn.mp4"
    assert n(None, None, None, None) == "Unknown.mp4"
    assert n(None, 3, "a/b?") == "Lanterns - E03 - a b.mp4"
    assert value(spark, T.replace_illegal(lit('a:b/c'))) == "a_b_c"
    label = lambda y, s, e: value(spark, T.media_label(lit("X"), F.lit(y).cast("int"), F.lit(s).cast("int"), F.lit(e).cast("int")))
    assert label(1986, 1, 3) == "X (1986) S01E03" and label(None, None, None) == "X"


@pytest.mark.parametrize("given,want", [("en-US", "en"), ("es_ES", "es"), ("it", "it"), ("!!!", None), ("Auto-detect", None), ("French", "fr"), ("Other", "other"), (None, None), ("", None)])
def test_languages(spark, given, want):
    assert value(spark, T.normalise_language(lit(given))) == want
    assert value(spark, T.uses_phonetics(lit(given))) == (want in (None, "en"))


def test_vote_language(spark):
    assert value(spark, T.vote_language(lit("le chat est dans la maison des voisins pour vous " * 2))) == "fr"
    assert value(spark, T.vote_language(lit("short"), "en")) == "en"


@pytest.mark.parametrize("stamp,want", [("00:00:02,000", 2000), ("01:02.5", 62500), ("1:00:00.1234", 3600123), ("x", 0), (None, 0)])
def test_timestamps(spark, stamp, want):
    assert value(spark, T.timestamp_ms(lit(stamp))) == want


def test_density(spark):
    d = lambda w, s: value(spark, T.dialogue_density(F.lit(w), F.lit(float(s))))
    assert (d(120, 60), d(60, 120), d(0, 60), d(5, 0)) == (120.0, 30.0, 0.0, 0.0)


def test_metaphone_anchors():
    assert len({double_metaphone(w)[0] for w in ("night", "nite", "knight")}) == 1
    assert double_metaphone("matlock")[0] == "MTLK"
    assert double_metaphone("their") == ("0R", "TR")
    assert double_metaphone("schmidt") == ("XMT", "SMT")
    assert word_key("42") == "42"


def test_metaphone_equals_the_library_on_the_driver(spark):
    words = set("school judge caesar chianti michael architect accident edge hugh laugh tough ghost gnome signal cagney danger biaggi jose cabrillo dumb philip island sugar szabo science schooner resnais nation thomas arnow filipowicz xavier breaux zhao pizza write wasserman bajador raspberry focaccia bellocchio mcclellan gallegos yankelovich objection harbor".split())
    other = spark._jvm.org.apache.commons.codec.language.DoubleMetaphone()
    other.setMaxCodeLen(64)
    for w in words:
        assert double_metaphone(w) == (other.doubleMetaphone(w, False), other.doubleMetaphone(w, True).replace(" ", "")), w


def test_phonetic_tokens_only_where_they_suit(spark):
    tokens = F.array(F.lit("night"), F.lit("42"))
    assert value(spark, phonetic_tokens(tokens, F.lit(True))) == ["NT", "42"]
    assert value(spark, phonetic_tokens(tokens, F.lit(False))) == ["night", "42"]


def test_sample_points(spark):
    assert sampling.sample_points(5) == [0.1, 0.3, 0.5, 0.7, 0.9]
    assert sampling.sample_points(1) == [0.5]
    assert sampling.sample_points(2, 0.05, 0.25) == [0.05, 0.75]
    assert sampling.sample_points(3, 0.9, 0.9) == [0.45, 0.5, 0.55]
    assert sampling.parse_points("10%, 0.5 90") == [0.1, 0.5, 0.9]
    assert value(spark, sampling.sample_points_column(F.lit(5))) == [0.1, 0.3, 0.5, 0.7, 0.9]


def test_sample_windows(spark):
    at = lambda d: [tuple(w) for w in value(spark, sampling.sample_windows(F.lit(float(d)), F.array(F.lit(0.1), F.lit(0.9)), 12.0))]
    assert at(1400) == [(140.0, 12.0), (1260.0, 12.0)]
    assert at(5) == [(0.0, 5.0)]
    assert at(0) == [(0.0, 12.0)]


def test_the_class_of_no_words_is_all_but_letters_digits_and_apostrophe(spark):
    """Its ranges and the negated class agree on every code point that text can hold."""
    points = [c for c in range(0x3000)] + [0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, t string")
    apart = df.where(F.regexp_replace("t", T.NO_WORD, " ") != F.regexp_replace("t", "[^a-z0-9']+", " "))
    assert apart.count() == 0


def test_clean_text_of_odd_cues(spark):
    rows = [" A-B--c\t\u00a0d ", "JOE: it's <i>[x]</i> (y) {z} 9", "<a [b> c]", "\u0130\u03a3 x\u2019y", "'' - '", "", None, "\n\n", "\U0001f600a\U0001f600", "no( open"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string")
    bare = T._replace(F.coalesce("t", F.lit("")), ("<[^>]+>", " "), (r"\{[^}]*\}", " "), (r"\[[^\]]*\]", " "), (r"\([^)]*\)", " "), (r"^[A-Z][A-Z0-9 .'-]{1,20}:", " "), ("-", " "))
    plain = F.trim(T._replace(F.lower(bare), (r"[^a-z0-9'\s]", " "), (r"\s+", " ")))
    got = df.select("k", T.clean_text(F.col("t")).alias("clean"), plain.alias("plain")).collect()
    assert len(got) == len(rows) and all(r.clean == r.plain for r in got)


def test_windows_of_empty_documents_equal_their_sql(spark, tmp_path):
    lengths = [0, -3, None, 1, 14, 15, 16, 179, 180, 181, 1800]
    docs = spark.createDataFrame([(k, "", "en", "s", n) for k, n in enumerate(lengths)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found, got = con.execute(queries.SQL["sample_windows"]), queries.QUERIES["sample_windows"](spark, str(tmp_path))
    assert oracle.rows(got.columns, got.collect()) == oracle.rows([c[0] for c in found.description], found.fetchall())
