"""A library on disk: built from subtitle folders, asked for whole batches of transcripts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FingerprintConfig, FuzzyConfig, MatchConfig, NgramConfig
from ..functions import text as T
from ..functions.phonetics import phonetic_tokens
from ..sources import subtitles as SRC
from ..sources.scratch import materialise
from . import fingerprint as FP
from . import language as LM
from . import library as L
from . import scoring as S
from . import verdict as V
from .store import Store


class Transcriber(Protocol):
    """Speech to text, from outside: the engine itself takes transcripts."""

    def transcribe(self, path: str, start_s: float, len_s: float) -> str: ...


def transcribe_windows(files: DataFrame, transcriber: Transcriber) -> DataFrame:
    """``files``: query_id, path, duration_s, windows (array of start_s, len_s, as
    ``sampling.sample_windows`` gives). query_id, part, start_s, duration_s, text: what the
    transcriber, which travels to the executors, makes of each window."""

    def heard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [transcriber.transcribe(p, s, n) for p, s, n in zip(batch["path"], batch["start_s"], batch["len_s"])]
            yield batch[["query_id", "part", "start_s", "duration_s"]].assign(text=texts)

    each = files.select("query_id", "path", "duration_s", F.posexplode("windows").alias("part", "w")).select("query_id", "path", "duration_s", "part", "w.start_s", "w.len_s")
    return each.mapInPandas(heard, "query_id long, part int, start_s double, duration_s double, text string")


def encoded(rows: DataFrame, config: FingerprintConfig, language: str | None = None) -> DataFrame:
    """``rows`` with text as ``tokens``: phonetic keys where the language suits, by the
    configured one, else by the column ``language``."""
    code = F.lit(config.language) if config.language or not language else F.col(language)
    return rows.withColumn("tokens", phonetic_tokens(FP.text_tokens(F.col("text"), config), T.uses_phonetics(code)))


def identify(windows: DataFrame, files: DataFrame, media: DataFrame, fingerprints: DataFrame, streams: DataFrame, match: MatchConfig = MatchConfig(), fuzzy: FuzzyConfig = FuzzyConfig(), ngram: NgramConfig = NgramConfig(), runtimes: DataFrame | None = None, factors: DataFrame | None = None, idf: DataFrame | None = None, scope: DataFrame | None = None, postings: DataFrame | None = None, grams: tuple[DataFrame, DataFrame] | None = None, mean: DataFrame | None = None) -> DataFrame:
    """Verdicts on a batch. ``windows``: query_id, part, start_s, duration_s, tokens. ``files``:
    query_id, filename, duration_s, n_words and, null if unknown, expected_show, query_title,
    file_season, file_episode. ``factors`` (hash, factor) and ``idf`` (token, idf) come from a
    library; without them they are computed from its tables, factors with the ``mean`` of their
    ``idf_mean`` if that is known. ``scope`` (query_id, media_id)
    names candidates for the later stages; ``postings`` and ``grams`` are their indexes
    (``token_postings``; ``gram_postings`` and ``gram_masses``).

    What is read again is written to the shared folder: the queries, their hits and the
    leaders of the exact stage. Queries that an early stage settles are taken out of the
    later ones by anti-joins."""
    media = media.withColumnRenamed("title", "media_title").drop("source", "year", "media_type", "language")
    asked = materialise(windows.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "tokens"))), lambda x: x["tokens"])).alias("tokens")))
    heard = F.trim(F.coalesce("text", F.lit(""))) != "" if "text" in windows.columns else F.size("tokens") > 0
    samples = windows.groupBy("query_id").agg(F.sum(heard.cast("int")).cast("int").alias("votes"), F.count(F.lit(1)).cast("int").alias("total_samples"))
    plain = materialise(FP.weighted_query(windows, tokens="tokens"))
    hits = materialise(L.lookup(fingerprints, plain))
    if factors is None:
        n = media.count()
        mean = materialise(S.idf_mean(L.document_frequency(fingerprints), n)) if mean is None else mean
        factors = S.idf_factors(L.document_frequency(hits), n, mean)
    query = materialise(S.apply_idf(plain, factors))
    scored = S.exact_scores(query, hits, match).select("query_id", "media_id", "confidence", "match_count", "rank")
    sizes = streams.select("media_id", F.size("tokens").alias("n_tokens"))
    facts = files.select("query_id", "duration_s", "n_words", "expected_show", "query_title")

    def boosted(found: DataFrame) -> DataFrame:
        return V.metadata_boosts(found.select("query_id", "media_id", "confidence", "match_count", "rank").join(media, "media_id").join(facts, "query_id"))

    exact = materialise(V.leaders(V.tie_breaks(boosted(scored).join(sizes, "media_id", "left"), match)))
    open_queries = asked.join(exact, "query_id", "left_anti")
    ordered = materialise(V.leaders(boosted(S.fuzzy_stage(open_queries, streams, fuzzy, match.top_n, scope, postings))))
    # A query that is settled well enough by either stage isn't asked again.
    firm = exact.unionByName(ordered, allowMissingColumns=True).where(F.col("confidence") >= ngram.replace_below)
    weak = materialise(asked.join(firm, "query_id", "left_anti"))
    found = materialise(S.ngram_stage(weak, streams, ngram, match.top_n, scope, idf, grams))
    sets = V.with_raw(V.leaders(boosted(found)), found)
    guess = V.cascade(exact, ordered, sets, ngram.replace_below).join(media, "media_id")
    return V.verdicts(files.drop("n_words", "expected_show", "query_title").join(samples, "query_id", "left"), guess, match, runtimes)


class Library(Store):
    """A library on disk. A build adds parts in proportion to its files; deletions, edits and
    replaced streams are small parts that count when tables are read (see ``store``)."""

    def __init__(self, spark: SparkSession, path: str, config: FingerprintConfig = FingerprintConfig()) -> None:
        super().__init__(spark, path)
        self.config = config

    def hash_factors(self) -> DataFrame:
        """hash, factor, from the document frequencies that changes have written."""
        return S.idf_factors(self.table("hash_df"), self.table("media").count())

    def token_idf(self) -> DataFrame:
        n = self.table("streams").count()
        return S.idf_of(self.table("token_df"), n)

    def _add_streams(self, state: dict[str, Any], streams: DataFrame) -> None:
        self.add(state, "streams", streams.select("media_id", "tokens", "starts"))
        fresh = self.parts("streams", [state["streams"][-1][0]])
        self.add(state, "postings", S.token_postings(fresh))
        self.add_run(state, "token_df", S.token_frequency(fresh))

    def _drop_streams(self, state: dict[str, Any], old: dict[str, DataFrame], gone: DataFrame) -> None:
        """Streams, postings and frequencies of ``gone`` (media_id), a written table."""
        self.forget(state, gone, "streams", "postings")
        self.add_run(state, "token_df", S.token_frequency(old["streams"].join(gone, "media_id", "left_semi")).withColumn("df", -F.col("df")))

    def _drop_fingerprints(self, state: dict[str, Any], old: dict[str, DataFrame], gone: DataFrame) -> None:
        self.forget(state, gone, "fingerprints")
        self.add_run(state, "hash_df", L.document_frequency(old["fingerprints"].join(gone, "media_id", "left_semi")).withColumn("df", -F.col("df")))

    def build(self, files: str | DataFrame, runtimes: DataFrame | None = None, force: bool = False, title: str | None = None, year: int | None = None, media_type: str | None = None, show_title: str | None = None, languages: LM.LanguageModel | None = None) -> dict[str, int]:
        """Adds the subtitle files under a folder, or those of a table of path and content;
        files that have fingerprints already are left out unless ``force``. What is given of
        title, year, media type and show wins over the file names. ``languages`` tells the
        language of each file, where the configuration names none; without it frequent words
        do. Returns the numbers of files and fingerprints added. Other builds may run at the same time."""
        self.check_path()
        cues = SRC.read_subtitles(self.spark, files) if isinstance(files, str) else SRC.subtitle_cues(files)
        cues = materialise(cues.withColumn("source", T.base_name(F.col("source"))))  # parsed once for all tables
        named = cues.select("source").distinct()

        def make(state: dict[str, Any]) -> dict[str, int]:
            old = {n: self.table(n, state) for n in ("media", "fingerprints", "streams")}
            todo = materialise(named if force else L.unprocessed(named, old["media"], old["fingerprints"]))
            done = todo.count()
            counts = {"files": done, "skipped": named.count() - done, "fingerprints": 0}
            if not done:
                return counts
            mine = cues.join(todo, "source", "left_semi")
            spoken = mine.groupBy("source").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])).alias("text"))
            language = F.lit(self.config.language) if self.config.language else T.vote_language(F.col("text"))
            length = L.subtitle_runtime(mine.withColumnRenamed("source", "media_id")).select(F.col("media_id").alias("source"), F.col("seconds").alias("duration_seconds"))
            spoken = spoken.select("source", T.file_metadata(F.col("source")).alias("m"), language.alias("language"), "text")
            if languages and not self.config.language:
                spoken = spoken.drop("language").join(LM.detect(spoken, languages, "source"), "source", "left")
            meta = spoken.select("source", "m", "language").join(length, "source", "left")
            told = lambda name, value, kind: F.coalesce(F.lit(value).cast(kind), F.col(f"m.{name}")).alias(name)
            incoming = meta.select(told("title", title, "string"), told("year", year, "int"), told("media_type", media_type, "string"), "m.season", "m.episode", "source", told("show_title", show_title, "string"), "m.episode_title", "duration_seconds", F.when(F.col("duration_seconds").isNotNull(), "subtitle").alias("duration_source"), "language")
            if runtimes is not None:
                incoming = L.with_runtimes(incoming, runtimes)
            self.add(state, "media", L.upsert(old["media"], incoming, changed_only=True, top=state["top"]))
            changed = self.parts("media", [state["media"][-1][0]])
            state["top"] = max(state["top"], changed.agg(F.max("media_id")).first()[0])
            fresh = materialise(changed.join(todo, "source", "left_semi").select("media_id", "source", "language"))
            if not old["fingerprints"].join(fresh, "media_id", "left_semi").isEmpty():
                gone = materialise(fresh.select("media_id"))
                self._drop_fingerprints(state, old, gone)
                self._drop_streams(state, old, gone)
            tokens = materialise(encoded(mine.join(fresh, "source"), self.config, "language"))
            self.add(state, "fingerprints", FP.library_fingerprints(tokens, self.config))
            added = self.parts("fingerprints", [state["fingerprints"][-1][0]])
            self.add_run(state, "hash_df", L.document_frequency(added))
            self._add_streams(state, FP.token_streams(tokens))
            return counts | {"fingerprints": added.count()}

        return self.change(make)

    def delete(self, gone: DataFrame | list[int]) -> int:
        """Media with all that belongs to them; how many there were. Identifiers aren't
        given again."""
        ids = gone if isinstance(gone, DataFrame) else self.spark.createDataFrame([(i,) for i in gone], "media_id long")

        def make(state: dict[str, Any]) -> int:
            old = {n: self.table(n, state) for n in ("media", "fingerprints", "streams")}
            here = materialise(old["media"].join(ids.select("media_id").distinct(), "media_id", "left_semi").select("media_id"))
            if n := here.count():
                self.forget(state, here, "media")
                self._drop_fingerprints(state, old, here)
                self._drop_streams(state, old, here)
            return n

        return self.change(make)

    def clear(self) -> None:
        """Everything; identifiers aren't given again."""

        def make(state: dict[str, Any]) -> None:
            state.update({n: [] for n in ("deletes", *self.SHAPES)})

        self.change(make)

    def update(self, rows: DataFrame) -> int:
        """New values of media: ``rows`` has media_id, once each, and some editable columns,
        which are taken as they are, nulls too. Returns the number of media that were met."""
        given = [c for c in rows.columns if c != "media_id"]
        if unknown := set(given) - set(L.EDITABLE):
            raise ValueError(f"not editable: {sorted(unknown)}")

        def make(state: dict[str, Any]) -> int:
            media = self.table("media", state)
            new = rows.select("media_id", *[F.col(c).cast(media.schema[c].dataType).alias(f"new_{c}") for c in given])
            both = materialise(media.join(new, "media_id").select(*[F.col(f"new_{c}").alias(c) if c in given else F.col(c) for c in media.columns]))
            if n := both.count():
                self.add(state, "media", both)
            return n

        return self.change(make)

    def replace_streams(self, incoming: DataFrame) -> int:
        """New token streams (media_id, tokens, starts) of known media; an empty one changes
        nothing. Returns how many were replaced."""

        def make(state: dict[str, Any]) -> int:
            old = {n: self.table(n, state) for n in ("media", "streams")}
            fresh = materialise(incoming.where(F.size("tokens") > 0).join(old["media"].select("media_id"), "media_id", "left_semi").select("media_id", "tokens", "starts"))
            if n := fresh.count():
                self._drop_streams(state, old, fresh.select("media_id"))
                self._add_streams(state, fresh)
            return n

        return self.change(make)

    def build_show(self, query: str, files: str | DataFrame, year: int | None = None, **options) -> dict[str, int]:
        """``build`` for the files of one show: "Title 1986", or a title and a year."""
        row = self.spark.range(1).select(T.parse_query(F.lit(query)).alias("q")).first()["q"]
        options.setdefault("show_title", row["title"])
        return self.build(files, title=row["title"], year=year or row["year"], **options)

    def identify(self, transcripts: DataFrame, **options) -> DataFrame:
        """Verdicts on files, in the order of input_pos if known. ``transcripts``: query_id,
        filename, part, start_s, duration_s, text (one row for each sampled window) and, if
        known, expected_show and input_pos."""
        windows = encoded(transcripts.select("query_id", "part", "start_s", "duration_s", "text"), self.config)
        known = lambda c, kind: F.col(c) if c in transcripts.columns else F.lit(None).cast(kind)
        words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
        files = transcripts.withColumns({"expected_show": known("expected_show", "string"), "input_pos": known("input_pos", "long"), "n": words})
        files = files.groupBy("query_id").agg(F.first("filename").alias("filename"), F.max("duration_s").alias("duration_s"), F.sum("n").cast("int").alias("n_words"), F.first("expected_show", True).alias("expected_show"), F.min("input_pos").cast("long").alias("input_pos"))
        named = T.parse_episode(F.col("filename"))
        files = files.withColumns({"query_title": named["episode_title"], "file_season": named["season"], "file_episode": named["episode"]})
        found = identify(windows, files, self.table("media"), self.table("fingerprints", slot=True), self.table("streams"), factors=self.hash_factors(), idf=self.token_idf(), postings=self.table("postings"), **options)
        return found.orderBy(F.asc_nulls_last("input_pos"), "query_id")
