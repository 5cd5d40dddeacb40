"""Substring deduplication by super-k-mer partitioning.

Every window of ``k`` words has a minimiser, the least hash among its runs of ``m``
words. Consecutive windows of a document that share one form a super-k-mer; it
travels once, as a packed string of its words, to the bucket of its minimiser, and
equal windows always meet there. A bucket numbers its words exactly, sorts its windows
and compares neighbours word by word, so counts are exact. Each window that also
starts in a document with a smaller identifier is reported as a span of words.

Two scans: the first counts super-k-mers in a fixed number of minimiser slots, which
sets the number of buckets and finds hot slots. Windows of a hot slot (a copied
document or a passage in a third of all rows) don't go to one bucket: they are keyed by
the window itself, merged to their first document before the shuffle, and joined back
by a join whose hot keys adaptive execution splits. Super-k-mers for one bucket from
one stretch of input are compressed together. Memory is one bucket or one document: a slot
of over ``LARGEST`` super-k-mers is hot at any size of the input, and the driver learns
the hot slots as bitmaps of at most 2 MB.

Defined results: null text has no words. A null identifier counts as larger than any
other. Rows that repeat an identifier don't remove each other's words; their equal
texts give equal rows. Texts under ``k`` words lose nothing. An empty table gives no
rows; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, may_contain, member_bitmaps, table

K, M = 13, 3
#: Slots of minimisers: 2 to the power, and one more for each doubling of the input over
#: ``SLOT_BYTES``, up to ``MORE_BITS``, by the planner's estimate of its size.
SLOT_BITS, MORE_BITS, SLOT_BYTES = 16, 8, 1 << 37
#: Super-k-mers of a bucket on average; of a slot that isn't hot whatever the mean; and of
#: the largest slot that isn't hot, at any size of the input.
BUCKET_SIZE, HOT, LARGEST = 40_000, 20_000, 500_000
#: Words read, and characters packed, before they are dealt out.
CHUNK_WORDS, FLUSH_CHARS = 200_000, 16 << 20
LONGEST = 64
NO_ID = (1 << 63) - 1

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of some documents, and for each word its document, that document's id and
    key, and the word's place."""
    for batch in batches:
        words, sizes, ids, keys = [], [], [], []
        last = len(batch) - 1
        for row, (doc, key, text) in enumerate(zip(batch["id"], batch["key"], batch["body"])):
            found = _WORDS(text)
            words += found
            sizes.append(len(found))
            ids.append(doc)
            keys.append(key)
            if len(words) >= CHUNK_WORDS or row == last:
                n = np.array(sizes)
                place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
                yield words, np.repeat(np.arange(len(n)), n), np.array(ids, np.int64), np.array(keys, np.int64), place
                words, sizes, ids, keys = [], [], [], []


def _super_k_mers(words: list[str], doc: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer of a chunk."""
    none = np.zeros(0, np.int64)
    if len(words) < k:
        return none, none, none.astype(np.uint64)
    h = _mix(pd.util.hash_array(np.array(words, object), categorize=False))
    run = h[: len(h) - m + 1].copy()
    for j in range(1, m):
        run = _mix(run * np.uint64(31) + h[j : len(h) - m + 1 + j])
    least, width, want = run, 1, k - m + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    if not len(at):
        return none, none, none.astype(np.uint64)
    low = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    if size.max() > LONGEST:  # a repeated phrase: cut, each part still holds whole windows
        parts = -(-size // LONGEST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(np.repeat(size, parts) - inner * LONGEST, LONGEST)
        first = np.repeat(first, parts) + inner * LONGEST
    return at[first], size, low[first]


def _slots(low: np.ndarray, bits: int) -> np.ndarray:
    return (low >> np.uint64(64 - bits)).astype(np.int64)


def _spans(flagged: np.ndarray, group: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows in one group: the first window's index, and the words
    from the run's first to behind its last."""
    at = np.flatnonzero(flagged)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (group[at[1:]] != group[at[:-1]])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return first, place[first], place[last] + k


def _equal_before(codes: np.ndarray, at: np.ndarray, order: np.ndarray, mark: np.ndarray, k: int) -> np.ndarray:
    """For windows in ``order``: whether each equals the one before it, word by word."""
    same = np.zeros(len(order), bool)
    same[1:] = mark[order[1:]] == mark[order[:-1]]
    near = np.flatnonzero(same)
    a, b = at[order[near]], at[order[near - 1]]
    equal = np.ones(len(near), bool)
    for j in range(k):
        equal &= codes[a + j] == codes[b + j]
    if not equal.all():
        return np.zeros(0, bool)
    return same


def repeated_windows(packed: list[str], ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of super-k-mers, in order: their super-k-mer, offset in it, and whether
    an equal window comes from a smaller id; last, the words of each super-k-mer."""
    words = " ".join(packed).split(" ")
    sizes = np.array([p.count(" ") + 1 for p in packed])
    codes = pd.factorize(np.array(words, object))[0].astype(np.int64)
    windows = sizes - k + 1
    group = np.repeat(np.arange(len(packed)), windows)
    offset = np.arange(len(group)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(sizes) - sizes, windows) + offset
    mark = np.zeros(len(at), np.uint64)
    coded = _mix(codes.astype(np.uint64) + np.uint64(1))
    for j in range(k):
        mark = mark * np.uint64(0x9E3779B97F4A7C15) + coded[at + j]
    doc = ids[group]
    order = np.lexsort((doc, mark))
    same = _equal_before(codes, at, order, mark, k)
    if not len(same):  # two windows with one mark: sort by the words themselves
        order = np.lexsort((doc, *(codes[at + j] for j in range(k))))
        same = np.zeros(len(order), bool)
        same[1:] = True
        for j in range(k):
            same[1:] &= codes[at[order[1:]] + j] == codes[at[order[:-1]] + j]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    flagged = np.zeros(len(order), bool)
    flagged[order] = doc[order] > doc[order[start]]
    return group, offset, flagged, sizes


def duplicate_spans(docs: DataFrame, k: int = K, m: int = M, slot_bits: int | None = None, bucket_size: int = BUCKET_SIZE, hot_size: int = HOT, largest: int = LARGEST) -> DataFrame:
    """``docs``: id, key (a hash of the body, 31 bits), body. Spans of words (id, key, a, b) whose windows also start in
    a document with a smaller id; spans of one document may overlap."""
    if slot_bits is None:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        known = size < 1 << 60  # the planner's word for any size that it doesn't know
        slot_bits = SLOT_BITS + min((size // SLOT_BYTES).bit_length() if known else 0, MORE_BITS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(1 << slot_bits, np.int64)
        for words, doc, _, _, _ in _chunks(batches):
            _, _, low = _super_k_mers(words, doc, k, m)
            slot, times = np.unique(_slots(low, slot_bits), return_counts=True)
            n[slot] += times
        at = np.flatnonzero(n)
        yield pd.DataFrame({"slot": at, "n": n[at]})

    slots = docs.mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    slots = materialise(slots)
    total = slots.agg(F.sum("n")).collect()[0][0] or 0
    most = min(max(hot_size, 8 * total >> slot_bits), largest)
    # One bit a slot: at most 512 bitmaps of 4 KB reach the driver and the workers.
    place = F.col("slot") + 1
    maps = slots.where(F.col("n") > most).groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    hot_bits = np.zeros(max(4096, (1 << slot_bits) // 8), np.uint8)
    for r in maps.collect():
        hot_bits[4096 * (r["at"] - 1) : 4096 * r["at"]] = np.frombuffer(r["bits"], np.uint8)

    def is_hot(low: np.ndarray) -> np.ndarray:
        slot = _slots(low, slot_bits).astype(np.int64)
        return (hot_bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    buckets = max(64, total // bucket_size)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[str] = []
        numbers: list[np.ndarray] = []  # bucket, id, key, place of each packed string
        chars, squeeze = 0, zstandard.ZstdCompressor(3)

        def deal() -> pd.DataFrame:
            number = np.concatenate(numbers)
            order = np.argsort(number[:, 0], kind="stable")
            number = number[order]
            edges = np.append(np.flatnonzero(np.diff(number[:, 0], prepend=-1)), len(number)).tolist()
            order, rows = order.tolist(), []
            for a, b in zip(edges, edges[1:]):
                columns = number[a:b, 1].tobytes() + number[a:b, 2:].T.astype(np.int32).tobytes()
                packed = "\n".join([texts[k] for k in order[a:b]])
                rows.append((int(number[a, 0]), squeeze.compress(columns), squeeze.compress(packed.encode("utf-8", "surrogatepass"))))
            return pd.DataFrame(rows, columns=["bucket", "numbers", "packed"])

        for words, doc, ids, keys, place in _chunks(batches):
            first, size, low = _super_k_mers(words, doc, k, m)
            cool = ~is_hot(low)
            first, size, low = first[cool], size[cool], low[cool]
            if not len(first):
                continue
            target = (_mix(low) % np.uint64(buckets)).astype(np.int64)
            numbers.append(np.column_stack([target, ids[doc[first]], keys[doc[first]], place[first]]))
            new = [" ".join(words[a:b]) for a, b in zip(first.tolist(), (first + size + k - 1).tolist())]
            texts += new
            chars += sum(map(len, new))
            if chars >= FLUSH_CHARS:
                yield deal()
                texts, numbers, chars = [], [], 0
        if numbers:
            yield deal()

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def spans(numbers: list[bytes], packed: list[str]) -> pd.DataFrame:
            number = np.concatenate(numbers)
            group, offset, flagged, _ = repeated_windows(packed, number[:, 0], k)
            first, a, b = _spans(flagged, group, offset + number[group, 2], k)
            owner = number[group[first]]
            return pd.DataFrame({"id": owner[:, 0], "key": owner[:, 1], "a": a, "b": b})

        at, numbers, packed, spread = None, [], [], zstandard.ZstdDecompressor()
        for batch in batches:
            for bucket, number, text in zip(batch["bucket"], batch["numbers"], batch["packed"]):
                if bucket != at and numbers:
                    yield spans(numbers, packed)
                    numbers, packed = [], []
                at = bucket
                columns = spread.decompress(number)
                n = len(columns) // 16
                numbers.append(np.column_stack([np.frombuffer(columns, np.int64, n), np.frombuffer(columns, np.int32, 2 * n, 8 * n).reshape(2, n).T]))
                packed += spread.decompress(text).decode("utf-8", "surrogatepass").split("\n")
        if numbers:
            yield spans(numbers, packed)

    shape = "id long, key long, a long, b long"
    found = docs.mapInPandas(pack, "bucket long, numbers binary, packed binary").repartition("bucket").sortWithinPartitions("bucket").mapInPandas(match, shape)
    if not hot_bits.any():
        return found

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for words, doc, ids, keys, place in _chunks(batches):
            first, size, low = _super_k_mers(words, doc, k, m)
            warm = is_hot(low)
            first, size = first[warm], size[warm]
            if not len(first):
                continue
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield pd.DataFrame({"window": [" ".join(words[x : x + k]) for x in at.tolist()], "id": ids[doc[at]], "key": keys[doc[at]], "a": place[at]})

    # Written once, read twice: a scan of all texts costs more than the hot windows.
    windows = materialise(docs.mapInPandas(single, "window string, id long, key long, a long"))
    firsts = windows.groupBy("window").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last")).select("window", "first")
    more = windows.join(firsts, "window").where(F.col("id") > F.col("first")).select("id", "key", "a", (F.col("a") + k).alias("b"))
    return found.unionByName(more)


def remove_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, the kept text."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("key", F.pmod(F.xxhash64("body"), F.lit(1 << 31)))
    spans = duplicate_spans(rows.select("id", "key", "body"), k, **options)
    marks = materialise(spans.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("s")).select("id", "key", F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.xxhash64("id", "key").alias("mark")))
    # Most documents lose nothing; their texts stay where they are.
    probed = rows.withColumn("mark", F.xxhash64("id", "key"))
    touched = may_contain(probed, "mark", member_bitmaps(marks, "mark"), keep=True)
    result = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    @F.pandas_udf(result)
    def cut(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for t, lows, highs in zip(text, a, b):
            words, kept, at, gone = _WORDS(t), [], 0, 0
            for x, y in zip(lows if lows is not None else (), highs if highs is not None else ()):
                if y <= at:
                    continue
                kept += words[at:x] if x > at else []
                gone += y - max(x, at)
                at = y
            kept += words[at:]
            joined = " ".join(kept)
            out.append((len(words), gone, hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest(), joined)[: 3 + with_text])
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept_text"][: 3 + with_text])

    none = F.lit(None).cast("array<bigint>")
    calm = touched.where(~F.col("maybe")).select("doc_id", "body", none.alias("a"), none.alias("b"))
    cut_up = touched.where("maybe").join(marks.drop("mark"), ["id", "key"], "left").select("doc_id", "body", "a", "b")
    return calm.unionByName(cut_up).select("doc_id", cut("body", "a", "b").alias("r")).select("doc_id", "r.*")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + {K} - 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {K} + 2)) AS p FROM w)),
f AS (SELECT x, min(doc_id) AS first FROM g GROUP BY 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(p, p + {K})) AS i FROM g JOIN f USING (x) WHERE first < doc_id),
gone AS (SELECT doc_id, list(i) AS gone FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
