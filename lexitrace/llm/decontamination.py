"""Benchmark decontamination by winnowing, with DataFrame operations only.

A window is ``length`` consecutive words of a benchmark item. Its fingerprint is the least
hash of its k-grams, k = length / 2: winnowing over length - k + 1 hashes, so two texts that
share a span of ``length`` words share a fingerprint there. Neighbouring windows mostly
share theirs, so a document gives one row for each run of windows with one fingerprint,
about a third as many as words. A filter of the benchmark's fingerprints, of a size that
follows their number, drops nearly all of these rows where they are made; the rest are
joined with the benchmark's fingerprints, and hits are extended to the windows of
their run, whose words are compared with the benchmark's windows in full. So every shared
window is found and nothing else is.

Items shorter than ``length`` are one window each; every length that occurs is a pass of
its own over the documents (``length`` - 1 more at most).

Texts are told apart by their sha256, so copies are one text behind the first join, and
texts that hit the same windows share the list of their items.

Defined results: null has no words. An item without words has no window. Rows that repeat
an item_id are one item; a null item_id is an item named 'null'. Repeated rows and null
identifiers of documents give a row each. Without items nothing is hit; without documents
there are no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, filter_bits, materialise, may_contain, member_bitmaps, table

LENGTH = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def plain_words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def fingerprint_rows(rows: DataFrame, length: int) -> DataFrame:
    """``rows`` (with ``words``), a row for each run of windows with one fingerprint:
    fingerprint, first, last, by the places of the windows' first words. None for rows of
    fewer words than ``length``."""
    k = (length + 1) // 2
    over, n = length - k + 1, F.size("words")
    coded = F.transform("words", lambda w: F.xxhash64(w))
    # Each step is a column of its own, used more than once, so that it is made once.
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get("__coded", i + j) for j in range(k)]))
    least = lambda i: F.least(F.get("__grams", i), *[F.get("__grams", i + j) for j in range(min(1, over - 1), over)])
    prints = F.transform(F.sequence(F.lit(0), n - length), least)
    starts = F.filter(F.sequence(F.lit(0), n - length), lambda i: (i == 0) | (F.get("__prints", i) != F.get("__prints", i - 1)))
    run = lambda i, at: F.struct(F.get("__prints", i).alias("fingerprint"), i.alias("first"), (F.coalesce(F.get("__starts", at + 1), n - length + 1) - 1).alias("last"))
    when = lambda c: F.when(n >= length, c)
    steps = rows.withColumn("__coded", coded).withColumn("__grams", when(grams) if k > 1 else F.col("__coded"))
    steps = steps.withColumn("__prints", when(prints)).withColumn("__starts", when(starts))
    # Outer, so that the planner doesn't make the runs twice to filter on their number.
    each = steps.select(*rows.columns, F.explode_outer(when(F.transform("__starts", run))).alias("__run")).where(F.col("__run").isNotNull())
    return each.select(*rows.columns, "__run.fingerprint", "__run.first", "__run.last")


def windows_of(words: Column, first: Column, last: Column, length: int) -> Column:
    """The windows that begin at ``first`` to ``last`` in ``words``, as texts."""
    return F.transform(F.sequence(first, last), lambda i: F.array_join(F.slice(words, i + 1, length), " "))


def item_windows(items: DataFrame, length: int) -> DataFrame:
    """item_id, size, window: what counts as a window of each item, without repeats."""
    size = F.least(F.lit(length), F.size("words"))
    every = items.where(F.size("words") > 0).select("item_id", size.alias("size"), "words")
    return every.select("item_id", "size", F.explode(windows_of(F.col("words"), F.lit(0), F.size("words") - F.col("size"), F.col("size"))).alias("window")).distinct()


def hit_windows(texts: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """key, first, size, window: occurrences of ``windows`` (window) of ``size`` words in
    ``texts`` (key, words)."""
    known = materialise(fingerprint_rows(windows.select(F.split("window", " ").alias("words")), size).select("fingerprint").distinct())
    bits = filter_bits(known.count())
    runs = may_contain(fingerprint_rows(texts, size), "fingerprint", member_bitmaps(known, "fingerprint", bits), bits=bits)
    # What a hit needs of its text goes with it: the words of its windows.
    near = runs.select("key", "fingerprint", "first", F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + size).alias("words"))
    hits = near.join(known, "fingerprint").select("key", "first", F.posexplode(windows_of(F.col("words"), F.lit(0), F.size("words") - size, F.lit(size))).alias("more", "window"))
    found = hits.select("key", (F.col("first") + F.col("more")).alias("first"), "window").join(windows.select("window"), "window", "left_semi")
    return found.select("key", "first", F.lit(size).alias("size"), "window")


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans: a row for each
    document. ``spans`` are the hit words as array of (first, last), runs of neighbours."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"), plain_words(F.col(item_text_col)).alias("words"))
    windows = materialise(item_windows(items, length))
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.sha2(body, 256).alias("key"), plain_words(body).alias("words"))
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # ``length`` rows at most
    hits = docs.sparkSession.createDataFrame([], "key string, first int, size int, window string")
    for size in sorted(sizes):
        hits = hits.unionByName(hit_windows(texts, windows.where(F.col("size") == size).select("window").distinct(), size))

    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["first"], x["first"] + x["size"] - 1)))))
    by_text = hits.groupBy("key").agg(F.collect_set(F.struct("first", "size")).alias("at"), F.array_sort(F.collect_set("window")).alias("windows"))
    by_text = materialise(by_text.select("key", hit.alias("hit"), F.sha2(F.array_join("windows", "\n"), 256).alias("hits"), "windows"))
    # The items of each set of windows, once for all texts that hit it.
    sets = by_text.groupBy("hits").agg(F.any_value("windows").alias("windows")).select("hits", F.explode("windows").alias("window"))
    named = sets.join(windows.select("window", "item_id"), "window").select("hits", "item_id").distinct()
    named = named.groupBy("hits").agg(F.array_sort(F.collect_list("item_id")).alias("items")).select("hits", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    known = by_text.select("key", "hit", "hits").join(named, "hits").select("key", "hit", "n_items", "items_sha256")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(body, 256).alias("key"), F.size(plain_words(body)).cast("long").alias("n_words"))
    starts = F.filter("hit", lambda p, i: (i == 0) | (F.get("hit", i - 1) != p - 1))
    ends = F.filter("hit", lambda p, i: (i == F.size("hit") - 1) | (F.get("hit", i + 1) != p + 1))
    spans = F.arrays_zip(starts.alias("first"), ends.alias("last"))
    known = known.select("key", F.size("hit").cast("long").alias("n_hit"), "n_items", "items_sha256", spans.alias("spans"))
    zero = F.lit(0).cast("long")
    return rows.join(known, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
    )


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words as runs are no digest of their own; SQL compares the rest."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def _sql_words(x: str) -> str:
    return f"regexp_extract_all(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


SQL = f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_sql_words('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least({LENGTH}, len(w)) AS size, unnest(list_transform(range(0, len(w) - least({LENGTH}, len(w)) + 1), lambda p: array_to_string(w[p + 1:p + least({LENGTH}, len(w))], ' '))) AS win FROM i WHERE len(w) > 0),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
p AS (SELECT r, size, w, unnest(range(0, len(w) - size + 1)) AS p FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size),
dw AS MATERIALIZED (SELECT r, size, p, array_to_string(w[p + 1:p + size], ' ') AS win FROM p),
h AS MATERIALIZED (SELECT r, size, p, win FROM dw WHERE (win, size) IN (SELECT win, size FROM iw)),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM h) GROUP BY 1),
m AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT r, item_id FROM h JOIN iw USING (win, size)) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
