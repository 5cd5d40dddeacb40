"""Column expressions over dialogue, file names, titles and language codes.

All are built-in expressions. Null input counts as empty unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry little meaning in dialogue.
STOPWORDS = ["the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "to", "of", "in", "on", "at", "for", "with", "as", "by", "it", "this", "that"]

#: Function words that can't be names.
NAME_STOPWORDS = """
a an the and or but if then else of to in on at by for with from into over
is are was were be been being am do does did have has had will would shall
should can could may might must i you he she it we they me him her us them my
your his its our their this that these those as so not no yes at up out off
""".split()

#: Tokens of release names that say nothing about the title.
JUNK_TOKENS = [
    "dvdrip", "dvd", "bdrip", "brrip", "bluray", "blu-ray", "webrip", "web-dl",
    "webdl", "web", "hdtv", "hdrip", "pdtv", "subrip", "srt", "vtt",
    "x264", "x265", "h264", "h265", "hevc", "xvid", "divx", "avc",
    "aac", "ac3", "dd5", "dd5.1", "dts", "mp3", "flac",
    "720p", "1080p", "1080i", "480p", "2160p", "4k", "hd", "sd",
    "10bit", "8bit", "hdr", "remux", "proper", "repack", "internal",
    "amzn", "nf", "hulu", "dsnp", "atvp", "eng", "english",
]

#: Patterns of season and episode, first match wins; the last only if
#: no other matches, and only for a number without digits around it.
EPISODE_PATTERNS = [
    r"[Ss](\d{1,2})[ ._-]?[Ee](\d{1,3})(?:[ ._-]?[Ee]\d{1,3})*",
    r"(\d{1,2})x(\d{2,3})",
    r"(?i)season[ ._-]?(\d{1,2}).*?episode[ ._-]?(\d{1,3})",
]
COMPACT_PATTERN = r"(?<!\d)(\d)(\d{2})(?!\d)"
YEAR = r"(?:19|20)\d{2}"

#: Roman numbers of parts.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
PART = r"(?i)[\s\-_]*\(?(?:part|pt\.?|p)?\s*(\d{1,2}|[ivx]{1,4})\)?\s*$"

#: Labels and codes of languages; the codes that phonetic keys suit.
LANGUAGE_LABELS = {"english": "en", "spanish": "es", "french": "fr", "german": "de", "other": "other"}
LANGUAGE_CODES = ["en", "es", "fr", "de"]
PHONETIC_LANGUAGES = ["en"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _replace(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


#: Runs of all but a-z, 0-9 and the apostrophe, as ranges: Java tests ``[^a-z0-9']`` ten times slower.
NO_WORD = r"[\x00-&(-/:-`{-\x{10FFFF}]+"


def clean_text(text: Column) -> Column:
    """Dialogue without markup, stage directions and a leading speaker, as lower-case
    words of a-z, 0-9 and apostrophes."""
    bare = _replace(_text(text), ("<[^>]+>", " "), (r"\{[^}]*\}", " "), (r"\[[^\]]*\]", " "), (r"\([^)]*\)", " "), (r"^[A-Z][A-Z0-9 .'-]{1,20}:", " "))
    return F.trim(F.regexp_replace(F.lower(bare), NO_WORD, " "))


def tokenize(text: Column, min_length: int = 2, drop_stopwords: bool = False) -> Column:
    """Words of clean text: those of ``min_length`` or more, and all numbers."""
    words = F.filter(F.split(clean_text(text), " "), lambda w: (F.length(w) >= min_length) & (w != "") | w.rlike("^[0-9]+$"))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS)) if drop_stopwords else words


def media_label(title: Column, year: Column, season: Column, episode: Column, media_type: Column | None = None) -> Column:
    """Title (Year) SxxEyy, as far as known; a movie has no number."""
    number = F.when(season.isNotNull() & episode.isNotNull(), F.format_string(" S%02dE%02d", season, episode)).when(episode.isNotNull(), F.format_string(" E%02d", episode))
    if media_type is not None:
        number = F.when(~media_type.eqNullSafe("movie"), number)
    return F.concat(_text(title), F.when(year.isNotNull() & (year != 0), F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""), _text(number))


def strip_language_code(name: Column) -> Column:
    """Name.en.srt to Name.srt."""
    return F.regexp_replace(_text(name), r"(?i)\.[a-z]{2,3}\.(srt|vtt)$", ".$1")


def base_name(path: Column) -> Column:
    """The last part of a path; slashes and back-slashes separate."""
    return F.regexp_extract(_text(path), r"[^/\\]*\z", 0)


def extension(path: Column) -> Column:
    """The extension with its dot, or ''; a leading dot starts no extension."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, 1, F.length(name) - F.length(extension(path)))


def clean_release_name(name: Column) -> Column:
    """A file name without extension, brackets, release group and junk tokens."""
    junk = "|".join(x.replace(".", r"\.") for x in JUNK_TOKENS)
    bare = _replace(stem(strip_language_code(name)), (r"[\[\{].*?[\]\}]", " "), (r"-[A-Za-z0-9]{2,}$", " "), (rf"(?i)\b({junk})\b", " "), (r"[._]+", " "), (r"\s{2,}", " "))
    return F.regexp_replace(bare, r"^[ \-_.]+|[ \-_.]+$", "")


def _episode_match(cleaned: Column) -> tuple[Column, Column, Column, Column]:
    """(found, season, episode, text behind the match)."""
    found, season, episode, tail = F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for p in reversed([*EPISODE_PATTERNS, COMPACT_PATTERN]):
        hit = cleaned.rlike(p)
        inner, flag = (p[4:], "(?is)") if p.startswith("(?i)") else (p, "(?s)")
        groups = rf"{flag}^.*?{inner}(.*)$"
        season = F.when(hit, F.regexp_extract(cleaned, p, 1).try_cast("int")).otherwise(season)
        episode = F.when(hit, F.regexp_extract(cleaned, p, 2).try_cast("int")).otherwise(episode)
        tail = F.when(hit, F.regexp_extract(cleaned, groups, 3)).otherwise(tail)
        found = hit | found
    return found, season, episode, tail


def parse_episode(name: Column) -> Column:
    """struct(season, episode, episode_title) of a file name; nulls where unknown."""
    _, season, episode, tail = _episode_match(clean_release_name(name))
    title = _replace(tail, (r"^\s*[-_.]+\s*", " "), (YEAR, " "), (r"[-_.]+", " "), (r"\s{2,}", " "))
    title = F.regexp_replace(title, r"^[ \-_.]+|[ \-_.]+$", "")
    return F.struct(season.alias("season"), episode.alias("episode"), F.nullif(title, F.lit("")).alias("episode_title"))


def file_metadata(name: Column) -> Column:
    """struct(title, year, media_type, season, episode, show_title, episode_title)."""
    base, episode = stem(name), parse_episode(name)
    cut = base
    for p in reversed([*EPISODE_PATTERNS, YEAR]):
        inner, flag = (p[4:], "(?is)") if p.startswith("(?i)") else (p, "(?s)")
        cut = F.when(base.rlike(p), F.regexp_extract(base, rf"{flag}^(.*?){inner}", 1)).otherwise(cut)
    title = F.trim(F.regexp_replace(cut, r"[._-]+", " "))
    title = F.when(title == "", base).otherwise(title)
    kind = F.when(episode["season"].isNotNull() | episode["episode"].isNotNull(), "tv").otherwise("movie")
    return F.struct(
        title.alias("title"),
        F.regexp_extract(base, YEAR, 0).try_cast("int").alias("year"),
        kind.alias("media_type"),
        episode["season"].alias("season"),
        episode["episode"].alias("episode"),
        F.when(kind == "tv", title).alias("show_title"),
        episode["episode_title"].alias("episode_title"),
    )


def parse_query(query: Column) -> Column:
    """struct(title, year): "Title 1986" to (Title, 1986)."""
    q = _text(query)
    return F.struct(F.trim(F.regexp_replace(q, rf"(?s)^(.*?){YEAR}(.*)$", "$1$2")).alias("title"), F.regexp_extract(q, YEAR, 0).try_cast("int").alias("year"))


def normalise_title(title: Column) -> Column:
    """Lower-case words of a title without a year in round brackets."""
    return F.trim(_replace(F.lower(F.regexp_replace(_text(title), r"\(\d{4}\)", " ")), ("[^0-9a-zA-Z]+", " ")))


def normalise_show(name: Column) -> Column:
    """A show's name without a year in round brackets; the input if nothing is left."""
    bare = F.trim(_replace(_text(name), (rf"\({YEAR}\)", " "), (r"\s+", " ")))
    return F.when(bare == "", name).otherwise(bare)


def normalise_part(title: Column) -> Column:
    """Any marker of a part at the end as "part N"; lower case."""
    t = F.trim(_text(title))
    number = F.lower(F.regexp_extract(t, PART, 1))
    roman = F.create_map(*[F.lit(x) for k, v in ROMAN.items() for x in (k, str(v))])
    plain = F.coalesce(F.try_element_at(roman, number), F.when(number.rlike("^[0-9]+$"), number.try_cast("int").cast("string")).otherwise(number))
    front = F.regexp_replace(F.regexp_replace(t, PART, ""), r"^[ \-_]+|[ \-_]+$", "")
    return F.when(t.rlike(PART), F.lower(F.trim(F.concat(front, F.lit(" part "), plain)))).otherwise(F.lower(t))


def same_title(a: Column, b: Column) -> Column:
    """Whether two titles are equal but for case and the form of a part marker."""
    return (F.lower(F.trim(_text(a))) == F.lower(F.trim(_text(b)))) | (normalise_part(a) == normalise_part(b))


def episode_id(season: Column, episode: Column) -> Column:
    """SxxEyy, Exx or movie."""
    return F.when(season.isNotNull() & episode.isNotNull(), F.format_string("S%02dE%02d", season, episode)).when(episode.isNotNull(), F.format_string("E%02d", episode)).otherwise("movie")


def sanitise_name(name: Column) -> Column:
    """A name without characters that file systems forbid."""
    return F.regexp_replace(F.trim(_replace(_text(name), (r'[\\/:*?"<>|]', " "), (r"\s+", " "))), r"\.+$", "")


def replace_illegal(name: Column) -> Column:
    """Forbidden characters as underscores."""
    return F.translate(_text(name), '\\/:*?"<>|', "_" * 9)


def suggested_name(show: Column, season: Column, episode: Column, title: Column, ext: Column) -> Column:
    """Show - SxxEyy - Title.ext, as far as known."""
    filled = lambda c: F.nullif(F.trim(_text(c)), F.lit(""))
    joined = F.concat_ws(" - ", filled(show), F.nullif(episode_id(season, episode), F.lit("movie")), filled(title))
    return F.concat(sanitise_name(F.when(joined == "", "Unknown").otherwise(joined)), _text(ext))


def normalise_language(value: Column) -> Column:
    """A label or code as two letters, 'other', or null."""
    v = F.lower(F.trim(_text(value)))
    base = F.split_part(F.replace(v, F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    labels = F.create_map(*[F.lit(x) for kv in LANGUAGE_LABELS.items() for x in kv])
    return (
        F.when(v.isin("", "auto", "auto-detect", "autodetect"), None)
        .when(v.isin(*LANGUAGE_LABELS), F.try_element_at(labels, v))
        .when(base.isin(*LANGUAGE_CODES, "other"), base)
        .when(base.rlike(r"^\p{L}{2}$"), base)
    )


def uses_phonetics(language: Column) -> Column:
    """Whether phonetic keys suit a language; unknown counts as English."""
    code = normalise_language(language)
    return code.isNull() | code.isin(*PHONETIC_LANGUAGES)


def _among(words: list[str]):
    return lambda w: w.isin(*words)


def vote_language(text: Column, default: str | None = None, min_chars: int = 40) -> Column:
    """A language from the share of frequent words; ``default`` for short texts. Our own
    heuristic, offline; it knows the languages that have labels."""
    #: Frequent words of four languages.
    frequent = {"en": "the and of to is that it was", "es": "el los las que una por con para", "fr": "le les des est dans une pour vous", "de": "der die das und ist nicht ein zu"}
    words = F.split(F.lower(_text(text)), r"[^\p{L}]+")
    votes = F.array(*[F.struct(F.size(F.filter(words, _among(own.split()))).alias("n"), F.lit(code).alias("code")) for code, own in frequent.items()])
    best = F.array_max(votes)
    return F.when((F.length(F.trim(_text(text))) < min_chars) | (best["n"] == 0), F.lit(default)).otherwise(best["code"])


def dialogue_density(words: Column, seconds: Column) -> Column:
    """Words a minute; 0 if either isn't positive."""
    return F.when((seconds > 0) & (words > 0), words / (seconds / 60.0)).otherwise(0.0)


def timestamp_ms(stamp: Column) -> Column:
    """Milliseconds of h:m:s,f or m:s.f; 0 for other forms."""
    s = F.replace(_text(stamp), F.lit(","), F.lit("."))
    p = r"^\s*(?:(\d+):)?(\d+):(\d+)(?:\.(\d*))?\s*$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(s, p, k), F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    ms = F.substring(F.rpad(F.regexp_extract(s, p, 4), 3, "0"), 1, 3).try_cast("long")
    return F.when(s.rlike(p), (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + F.coalesce(ms, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
