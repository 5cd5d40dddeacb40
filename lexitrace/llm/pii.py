"""Personal data: pattern spans, and terms that disclose what the patterns protect.

Base spans follow four fixed patterns, leftmost and non-overlapping for each kind.
Places come from splitting the text at the matches and summing lengths, all in SQL
expressions; possessive quantifiers keep the matcher linear and its stack flat. Sums run
in stretches of fixed length and texts are cut in blocks, so that a text full of matches
costs little more than in proportion. Literals assigned to a key, token, secret or
password are spans of the kind ``secret``.

The protected entities are the matched values. Counts are over distinct texts, so that
copies of a text are no evidence. Terms are the words of a text whose spans so far are
blanked out. A term is near an entity if it lies within ``radius`` code points of it on
its line. With N texts, df(t) that hold term t, df(c) that hold entity c and df(c, t)
where t is near c, P(c) = df(c) / N and

    P(c | t) = (df(c, t) + m P(c)) / (df(t) + m),
    PMI(c; t) = ln(P(c | t) / P(c)),   IC(c) = -ln P(c),

and t discloses c if PMI reaches ``disclosure`` of IC: knowing t then gives away that
share of the information in c. The smoothing m draws little evidence towards
independence without a floor: a value that one text holds is disclosed by a word that
occurs nowhere else. ``support`` may ask for more texts where t is near c. A disclosing
term has kind ``term`` wherever it occurs, in any text; ``sanitised`` replaces spans by
their kind and generalises terms with a digit to their shape or removes the others.

Words of all texts pass bitmap filters of fixed size, of the terms near entities for
df(t) and of the disclosing terms for their places; exact joins drop what a filter let
through by chance. Texts are moved only where a disclosing term occurs.

Defined results: null text counts as empty; without matches the lists are empty. Every row
is judged, whatever its identifier; rows with equal texts count once, whether they repeat
an identifier or not. An empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, may_contain, member_bitmaps, table

#: The four base patterns, in the order of their kinds. (?: \G | not
#: after a local character) starts an e-mail only where a leftmost search would.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A literal behind a name of a secret and a sign of assignment.
SECRET = r"""(?i)(?<=(?:key|token|secret|password|passwd|pwd)["']?\s?[:=]\s?["'])[A-Za-z0-9_+/=.-]{12,}+"""
PATTERNS = KINDS | {"secret": SECRET}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

DISCLOSURE = 0.9
SUPPORT = 1
#: m, in texts.
SMOOTHING = 0.1
RADIUS = 60
#: What terms are made of, and what ends them.
WORD, GAP = r"[\p{L}\p{N}_'-]+", r"[^\p{L}\p{N}_'-]+"

SPAN = "struct<kind:string,start:int,end:int,value:string>"
#: Values that a running sum copies at a time; code points of a block of text (2 to the
#: power).
STRETCH, BLOCK_BITS = 128, 8


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``op`` over an array of integers (a bound
    one): first within stretches, then carried from stretch to stretch."""

    def short(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(op(F.try_element_at(acc, F.lit(-1)), x), x))))

    def carried(parts: Column) -> Column:
        ends = short(F.transform(parts, lambda p: F.element_at(p, -1)))
        return _let(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda x: op(F.get(e, k - 1), x))))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRETCH).cast("int")), lambda k: short(F.slice(values, k * STRETCH + 1, F.lit(STRETCH))))
    return F.when(F.size(values) <= STRETCH, short(values)).otherwise(_let(cut, carried))


def _sums(values: Column) -> Column:
    return _running(values, lambda a, b: a + b)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))


def _cut(blocks: Column, a: Column, b: Column) -> Column:
    """Code points ``a`` to ``b`` (exclusive) of a text in blocks; only the blocks that
    they lie in are read."""
    first, last = F.shiftright(a, BLOCK_BITS), F.shiftright(b - 1, BLOCK_BITS)
    held = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(b <= a, F.lit("")).otherwise(F.substring(held, a - F.shiftleft(first, BLOCK_BITS) + 1, b - a))


def _rewritten(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``put(span, free)`` in place of each of ``spans`` (sorted by start);
    what a span shares with those before it goes to them, ``free`` is where it starts alone."""

    def built(ends: Column, blocks: Column, xs: Column) -> Column:
        behind = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
        piece = F.transform(xs, lambda x, k: F.concat(_cut(blocks, behind(k), F.greatest(behind(k), x["start"])), F.when(x["end"] > behind(k), put(x, F.greatest(behind(k), x["start"]))).otherwise("")))
        return F.concat(F.array_join(piece, ""), _cut(blocks, F.element_at(ends, -1), F.length(text)))

    ends = lambda xs: _running(F.transform(xs, lambda x: x["end"]), F.greatest)
    return F.when(F.size(spans) == 0, text).otherwise(_let(spans, lambda xs: _let(ends(xs), lambda e: _let(_blocks(text), lambda blocks: built(e, blocks, xs)))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn test."""
    each = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(F.filter(each, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _accepted(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(f"^{PART}(?:\\.{PART}){{3}}$"),
        "card": n.between(13, 19) & F.when(n.between(13, 19), _luhn(value)).otherwise(False),
        "phone": n.between(9, 15),
        "secret": F.lit(True),
    }[kind]


def _spans(body: Column, kind: str) -> Column:
    """Accepted matches of one kind as (kind, start, end, value), by start."""
    pattern, none = PATTERNS[kind], F.array().cast(f"array<{SPAN}>")
    needs = {
        "email": F.contains(body, F.lit("@")),
        "phone": F.contains(body, F.lit("+")),
        "ip": body.rlike("[0-9]\\.[0-9]"),
        "card": body.rlike("[0-9](?:[\\x20-]?[0-9]){12}"),
        "secret": body.rlike("(?i)(?:key|token|secret|password|passwd|pwd)[\"']?\\s?[:=]"),
    }[kind]

    def placed(found: Column, gaps: Column) -> Column:
        ends = F.transform(found, lambda v, k: F.get(gaps, k) + F.length(v))
        span = lambda e: F.transform(found, lambda v, k: F.struct(F.lit(kind).alias("kind"), (e[k] - F.length(v)).alias("start"), e[k].alias("end"), v.alias("value")))
        return F.filter(_let(ends, lambda x: _let(_sums(x), span)), lambda x: _accepted(kind, x["value"]))

    gaps = F.transform(F.split(body, pattern, -1), F.length)
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    return F.when(needs, _let(found, lambda f: _let(gaps, lambda g: placed(f, g))).cast(f"array<{SPAN}>")).otherwise(none)


def _by_place(spans: Column) -> Column:
    """(start, end, kind, value) in order."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, body, ``base``, the spans of the four kinds as listed, by start, ``more``,
    those of secrets, and ``blank``, the body with spaces for both (null without any)."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"))
    found = F.concat(*[_spans(F.col("body"), k) for k in KINDS])
    rows = rows.select("doc_id", "body", F.explode(F.array(F.struct(found.alias("base"), _spans(F.col("body"), "secret").alias("more")))).alias("s")).select("doc_id", "body", "s.*")
    spans = F.concat("base", "more")
    blank = _rewritten(F.col("body"), _by_place(spans), lambda x, free: F.repeat(F.lit(" "), x["end"] - free))
    return rows.withColumn("blank", F.when(F.size(spans) > 0, blank))


def _near(blocks: Column, size: Column, span: Column, radius: int) -> Column:
    """Distinct terms within ``radius`` of ``span`` on its line; words that go on beyond
    it are none. One code point more on either side tells which do."""
    left = F.regexp_extract(_cut(blocks, F.greatest(span["start"] - radius - 1, F.lit(0)), span["start"]), r"[^\n]*\z", 0)
    right = F.regexp_extract(_cut(blocks, span["end"], F.least(span["end"] + radius + 1, size)), r"^[^\n]*", 0)
    left = F.when(F.length(left) > radius, F.regexp_replace(left, f"^{WORD}", "")).otherwise(left)
    right = F.when(F.length(right) > radius, F.regexp_replace(right, f"{WORD}\\z", "")).otherwise(right)
    words = F.split(F.concat(left, F.lit(" "), right), GAP, -1)
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 1), F.lower))


def term_occurrences(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """row, entity, term for terms near an entity, distinct within a row."""
    near = lambda blocks, size: F.transform(F.concat("base", "more"), lambda s: F.struct(s["value"].alias("entity"), _near(blocks, size, s, radius).alias("terms")))
    each = _let(_blocks(F.col("blank")), lambda blocks: _let(F.length("blank"), lambda size: near(blocks, size)))
    held = found.where(F.col("blank").isNotNull()).select("row", F.explode(each).alias("n"))
    return held.select("row", "n.entity", F.explode("n.terms").alias("term")).distinct()


def _text() -> Column:
    return F.coalesce("blank", "body")


def _terms(text: Column) -> Column:
    """The distinct words of ``text``, as terms."""
    return F.array_distinct(F.transform(F.split(text, GAP, -1), F.lower))


def disclosing_terms(met: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(entity, term) with PMI of at least ``disclosure`` times the entity's IC."""
    texts = materialise(found.groupBy("digest").agg(F.min("row").alias("row")).select("row"))
    n_texts = texts.count()
    pairs = met.join(texts, "row", "left_semi").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_ct")).where(F.col("df_ct") >= support)
    likely = materialise(pairs)
    holders = found.where(F.col("blank").isNotNull()).select("row", F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s["value"])).alias("values")).join(texts, "row", "left_semi")
    entities = holders.select(F.explode("values").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_c"))
    # Only what the filter takes for copies is moved to leave the copies out.
    copies = materialise(found.select("row").join(texts, "row", "left_anti"))
    marked = may_contain(found.select("row", _text().alias("text")), "row", member_bitmaps(copies, "row"), keep=True)
    once = marked.where(~F.col("maybe")).unionByName(marked.where("maybe").join(copies, "row", "left_anti"))
    words = once.select(F.explode(_terms(F.col("text"))).alias("term"))
    counted = may_contain(words, "term", member_bitmaps(likely, "term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    scored = likely.join(entities, "entity").join(counted, "term")
    prior = F.col("df_c") / F.lit(float(n_texts))
    pmi = F.log((F.col("df_ct") + SMOOTHING * prior) / (F.col("df_t") + SMOOTHING) / prior)
    known = -F.log(prior)
    return scored.where((known > 0) & (pmi >= disclosure * known)).select("entity", "term")


def term_places(found: DataFrame, told: DataFrame) -> DataFrame:
    """row and ``terms``: the spans of the terms of ``told``, by start; rows without any
    are left out. Written to the shared folder."""
    terms = materialise(told.select("term").distinct())
    bitmaps = member_bitmaps(terms, "term")
    words = found.select("row", F.explode(_terms(_text())).alias("term"))
    held = materialise(may_contain(words, "term", bitmaps).join(terms, "term", "left_semi"))
    rows = may_contain(found.select("row", _text().alias("text")), "row", member_bitmaps(held, "row"))
    sizes = lambda words, gaps: F.transform(words, lambda w, k: F.length(w) + F.coalesce(F.length(F.get(gaps, k)), F.lit(0)))
    place = lambda words, ends: F.transform(words, lambda w, k: F.struct(F.coalesce(F.get(ends, k - 1), F.lit(0)).alias("start"), F.length(w).alias("size"), F.lower(w).alias("term")))
    placed = _let(F.split("text", GAP, -1), lambda words: _let(F.regexp_extract_all("text", F.lit(GAP), F.lit(0)), lambda gaps: _let(sizes(words, gaps), lambda x: _let(_sums(x), lambda ends: place(words, ends)))))
    every = rows.select("row", F.explode(placed).alias("w")).select("row", "w.*")
    # What the filter lets through is joined by row and term, so no term is a hot key.
    told_here = may_contain(every, "term", bitmaps).join(held, ["row", "term"])
    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"), "term")
    listed = told_here.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("s"))
    kinds = F.transform("s", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["term"].alias("value")))
    return materialise(listed.select("row", kinds.cast(f"array<{SPAN}>").alias("terms")))


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, body (null where nothing was found), ``base`` and ``added`` spans (secrets,
    then terms, each by start)."""
    base = base_spans(docs, id_col, text_col)
    found = materialise(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "body", "base", "more", "blank", F.sha2("body", 256).alias("digest")))
    told = disclosing_terms(term_occurrences(found, radius), found, disclosure, support)
    places = term_places(found, told)
    marked = may_contain(found.drop("digest", "blank"), "row", member_bitmaps(places, "row"), keep=True)
    calm = marked.where(~F.col("maybe")).withColumn("terms", F.array().cast(f"array<{SPAN}>"))
    both = calm.unionByName(marked.where("maybe").join(places, "row", "left").withColumn("terms", F.coalesce("terms", F.array().cast(f"array<{SPAN}>"))))
    added = F.concat("more", "terms")
    return both.select("doc_id", F.when(F.size("base") + F.size(added) > 0, F.col("body")).alias("body"), "base", added.alias("added"))


def _shape(s: Column) -> Column:
    generalised = F.regexp_replace(s["value"], "[0-9]", "0")
    return F.when(s["kind"] != "term", F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["value"].rlike("[0-9]"), generalised).otherwise("")


def sanitised(body: Column, spans: Column) -> Column:
    """``body`` with its spans as their kind in square brackets, terms with a digit as
    their shape (0 for digits), and without the other terms."""
    return _rewritten(body, _by_place(spans), lambda s, free: _shape(s))


def sanitise(found: DataFrame) -> DataFrame:
    """doc_id and the sanitised text of rows with spans."""
    return found.where(F.col("body").isNotNull()).select("doc_id", sanitised(F.col("body"), F.concat("base", "added")).alias("text"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, then what the method added, and the sanitised text of rows
    where anything was found."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda spans, test, name: F.size(F.filter(spans, test)).cast("long").alias(name)
    of = lambda spans, kind: count(spans, lambda s: s["kind"] == kind, f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    generalised = lambda s: (s["kind"] == "term") & s["value"].rlike("[0-9]")
    return found.select(
        "doc_id",
        *[of("base", k) for k in KINDS],
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        of("added", "secret"),
        of("added", "term"),
        (F.size("base") + F.size(F.filter("added", lambda s: s["kind"] == "secret"))).cast("long").alias("n_private"),
        count("added", generalised, "n_generalised"),
        count("added", lambda s: (s["kind"] == "term") & ~s["value"].rlike("[0-9]"), "n_removed"),
        sanitised(F.col("body"), F.concat("base", "added")).alias("sanitised"),
    )
