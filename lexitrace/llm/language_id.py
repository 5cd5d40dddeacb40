"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet for each row: the likelihood of its whole text under byte
trigram models, the declared markup language, the last label of its address, and a
prior of its host. What a declaration or a suffix is worth is learned from all rows:
grouped sums of text posteriors give P(declared | language) and P(suffix | language).
Host priors are smoothed along a hierarchy, host to registered domain to all rows,
and leave out the row they judge. Trigrams of one text depend on each other, so a text
counts as at most ``effective`` independent ones.

Only the trigram model is fitted on a sample: at most ``max_train`` labelled documents
with the smallest identifier hashes, whole texts. Its counts, at most 2^15 for each
language, are all that reaches the driver. Posteriors and evidence cover every row.

Defined results: null or empty text is no text evidence; a missing or unknown
declaration, suffix or host counts as a value of its own; ties go to the language that
sorts first; repeated rows give equal rows; without labelled rows ``lang`` is null and
``confidence`` 0; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .html_text import content_blocks

MAX_TRAIN = 8000
BUCKETS = 1 << 15
EFFECTIVE = 200.0
#: Weight, in rows, of the level above in host priors, and of unseen evidence.
STRENGTH, PSEUDO = 5.0, 0.5
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def _trigrams(raw: bytes) -> np.ndarray:
    """Bucket numbers of the byte trigrams of a text, spaces added at its ends."""
    b = _LOWER[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return (code * np.uint32(2654435761) >> np.uint32(17)).astype(np.int32)


def _pieces(text: str):
    raw = text.encode("utf-8", "replace")
    for k in range(0, len(raw), CHUNK):
        yield raw[max(0, k - 2) : k + CHUNK]


def train(docs: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their log probabilities of each bucket."""
    known = docs.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.col(label_col)).alias("lang"))
    # At most max_train rows are broadcast: the limit is the proof.
    chosen = known.orderBy(F.xxhash64("id"), "id", "lang").limit(max_train)
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("lang", "text")

    def count(batches):
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                n = np.zeros(BUCKETS, np.int64)
                for text in texts:
                    for raw in _pieces(text):
                        n += np.bincount(_trigrams(raw), minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    counted = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.collect()
    langs = sorted({r["lang"] for r in rows})
    n = np.full((BUCKETS, len(langs)), 0.5)
    for r in rows:
        n[r["bucket"], langs.index(r["lang"])] += r["n"]
    return langs, np.log(n / n.sum(axis=0)).astype(np.float32)


def text_posteriors(model: np.ndarray, effective: float = EFFECTIVE, html: bool = False):
    """A UDF: posteriors under equal priors from the whole text (or a page's main text)."""

    def judge(text: str) -> list[float]:
        total, n = np.zeros(model.shape[1]), 0
        for raw in _pieces("\n".join(content_blocks(text)) if html else text):
            codes = _trigrams(raw)
            n += len(codes)
            total += model[codes].sum(axis=0, dtype=np.float64)
        x = total * (min(n, effective) / n) if n else total
        x = np.exp(x - x.max())
        return x / x.sum()

    @F.pandas_udf("array<double>")
    def posteriors(texts: pd.Series) -> pd.Series:
        return texts.map(judge)

    return posteriors


def fuse(rows: DataFrame, langs: list[str], strength: float = STRENGTH, pseudo: float = PSEUDO) -> DataFrame:
    """``rows`` (any columns, declared, suffix, host, domain, text_p) with lang, confidence
    and text_lang. The named evidence columns go."""
    n, ks = len(langs), range(len(langs))
    total = lambda by: rows.groupBy(*by).agg(*[F.sum(F.col("text_p")[k]).alias(f"n{k}") for k in ks])
    everywhere = total([]).collect()[0]
    mass = [float(everywhere[f"n{k}"] or 0.0) for k in ks]
    base = [(m + pseudo) / (sum(mass) + pseudo * n) for m in mass]

    def evidence(by: str, values: int) -> DataFrame:
        """log P(value | language) from grouped sums."""
        return total([by]).select(by, F.array(*[F.log((F.col(f"n{k}") + pseudo) / (mass[k] + pseudo * values)) for k in ks]).alias(f"{by}_log"))

    # At most one row for each language, 'other' and 'none'.
    declared = F.broadcast(evidence("declared", n + 2))
    # A host has one domain and one suffix: the levels meet on the distinct hosts, and
    # the rows need one join, whose hot hosts adaptive execution splits.
    hosts = total(["suffix", "domain", "host"]).select("suffix", "domain", "host", F.array(*[F.col(f"n{k}") for k in ks]).alias("host_n"))
    fold = lambda by: hosts.groupBy(by).agg(F.array(*[F.sum(F.col("host_n")[k]) for k in ks]).alias(f"{by}_n"))
    values = hosts.select("suffix").distinct().count()
    suffixes = fold("suffix").select("suffix", F.array(*[F.log((F.col("suffix_n")[k] + pseudo) / (mass[k] + pseudo * values)) for k in ks]).alias("suffix_log"))
    hosts = hosts.join(fold("domain"), "domain").join(suffixes, "suffix")
    out = rows.join(declared, "declared").join(hosts, ["suffix", "domain", "host"])
    own = lambda c, k: F.greatest(F.col(c)[k] - F.col("text_p")[k], F.lit(0.0))  # noqa: E731  without the row itself
    add = lambda x: reduce(lambda a, b: a + b, x)
    out = out.withColumn("domain_p", F.array(*[(own("domain_n", k) + strength * base[k]) / (add([own("domain_n", j) for j in ks]) + strength) for k in ks]))
    out = out.withColumn("host_p", F.array(*[(own("host_n", k) + strength * F.col("domain_p")[k]) / (add([own("host_n", j) for j in ks]) + strength) for k in ks]))
    out = out.withColumn("score", F.array(*[F.log(F.greatest(F.col("text_p")[k], F.lit(1e-300))) + F.col("declared_log")[k] + F.col("suffix_log")[k] + F.log(F.col("host_p")[k]) for k in ks]))
    out = out.withColumn("top", F.array_max("score"))
    names = F.array(*map(F.lit, langs))
    first = lambda c: names[F.array_position(F.col(c), F.array_max(c)).cast("int") - 1]
    confidence = 1.0 / add([F.exp(F.col("score")[k] - F.col("top")) for k in ks])
    kept = [c for c in rows.columns if c not in ("declared", "suffix", "host", "domain", "text_p")]
    return out.select(*kept, first("score").alias("lang"), confidence.alias("confidence"), first("text_p").alias("text_lang"))


def address(url: Column) -> tuple[Column, Column, Column]:
    """(host, registered domain: the last two labels, last label) of an address, or ''."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return host, F.regexp_extract(host, "([^.]*\\.)?[^.]*$", 0), F.regexp_extract(host, "[^.]*$", 0)


def declaration(value: Column, langs: list[str]) -> Column:
    """The primary subtag if it is one of ``langs``, 'other', or 'none'."""
    tag = F.lower(F.regexp_extract(F.coalesce(value, F.lit("")), "^\\s*([A-Za-z]+)", 1))
    return F.when(tag == "", "none").when(tag.isin(*langs), tag).otherwise("other")


#: The attribute lang of the html element, not one whose name only ends so.
MARKUP = "(?is)<html\\b[^>]*?[\\s\"'/]lang\\s*=\\s*[\"']?([A-Za-z-]+)"


def identify_languages(docs: DataFrame, pages: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """A row for each document (declared: its lang; host: its source) and each page
    (declared: its html element's lang): doc_id, page_id, lang, confidence, text_lang."""
    langs, model = train(docs, max_train)
    none = F.lit(None).cast("long")
    if not langs:
        shape = lambda df, d, p: df.select(d.alias("doc_id"), p.alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
        return shape(docs, F.col("doc_id"), none).unionByName(shape(pages, none, F.col("page_id")))
    host, domain, suffix = address(F.col("url"))
    markup = F.regexp_extract(F.coalesce("html", F.lit("")), MARKUP, 1)
    source = F.coalesce("source", F.lit(""))
    of_docs = docs.select(F.col("doc_id").cast("long"), none.alias("page_id"), declaration(F.col("lang"), langs).alias("declared"), F.lit("").alias("suffix"), source.alias("host"), F.lit("").alias("domain"), text_posteriors(model)(F.coalesce("text", F.lit(""))).alias("text_p"))
    of_pages = pages.select(none.alias("doc_id"), F.col("page_id").cast("long"), declaration(markup, langs).alias("declared"), suffix.alias("suffix"), host.alias("host"), domain.alias("domain"), text_posteriors(model, html=True)(F.coalesce("html", F.lit(""))).alias("text_p"))
    return fuse(materialise(of_docs.unionByName(of_pages)), langs)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = identify_languages(docs, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("confidence", F.round("confidence", 6)).withColumn("kept", F.col("confidence") >= 0.5)
