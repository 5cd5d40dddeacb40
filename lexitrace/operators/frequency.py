"""Document frequencies of all hashes of a library, with little to shuffle.

Most shingles lie in one media, and so does every longer shingle that holds such a one. A
first pass tells, by short numbers of the shortest shingles, which may lie in several. A
second counts what can't on the spot; only the rest is shuffled, as sorted numbers of which
the gaps are kept. Where numbers meet by chance more is shuffled, nothing is lost.

``tokens``: media_id, tokens, as cues; the rows of a media lie in one part, in a row
(``tables.in_a_row``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FingerprintConfig
from ..sources.scratch import materialise
from .fingerprint import DEFAULT

#: Bits of the numbers of the first pass; numbers that a task packs at a time; bits of the
#: filter of what may lie in several media (128 MB at most).
SHORT, CHUNK, LEAST_BITS, MOST_BITS = 40, 1 << 22, 20, 30
_PACKED = "bucket int, alone long, data binary"
#: MD5: texts hashed at a time, the longest that one block holds, constants of its steps.
TEXTS, BLOCK = 1 << 12, 55
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [np.uint32(x) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(words: np.ndarray, most: int) -> list[np.ndarray]:
    """At k the 64-bit numbers of the shingles of k words from each place on, from those of
    words; meaningless where fewer words follow."""
    out = [words, _mix(words)]
    for k in range(2, most + 1):
        longer, n = np.zeros_like(words), max(0, len(words) - k + 1)
        longer[:n] = _mix(out[-1][:n] * np.uint64(3) + words[k - 1 :][:n])
        out.append(longer)
    return out


def packed(values: np.ndarray, low: int) -> bytes:
    """Sorted numbers from ``low`` on as gaps of equal width."""
    gaps = np.diff(values, prepend=np.uint64(low))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, low: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    gaps = np.zeros((len(raw), 8), np.uint8)
    gaps[:, : data[0]] = raw
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(low)


def _md5(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of the MD5 of texts of at most ``BLOCK`` bytes, as a number;
    ``text`` ends in 64 bytes more."""
    place, start = np.arange(64), np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
    block = text[begin[:, None] + place] * (place < size[:, None])
    block[np.arange(len(size)), size] = 0x80
    words = np.ascontiguousarray(block.astype(np.uint8, copy=False).view("<u4").T)
    words[14] = size * 8
    a, b, c, d = (np.full(len(size), x, np.uint32) for x in start)
    for i, (sine, turn) in enumerate(zip(_SINES, _TURNS)):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), 5 * i + 1
        elif i < 48:
            f, at = b ^ c ^ d, 3 * i + 5
        else:
            f, at = c ^ (b | ~d), 7 * i
        f = f + a + words[at % 16] + sine
        a, b, c, d = d, b + ((f << turn) | (f >> (np.uint32(32) - turn))), b, c
    high, low = ((x + y).byteswap().astype(np.uint64) for x, y in ((a, start[0]), (b, start[1])))
    return (high << np.uint64(32)) | low


def digests(text: np.ndarray, begin: np.ndarray, end: np.ndarray, algorithm: str) -> np.ndarray:
    """The first eight bytes of the digest of each stretch of ``text``, as numbers."""
    size, padded = end - begin, np.concatenate([text, np.zeros(64, np.uint8)])
    out, short = np.empty(len(size), np.uint64), (size <= BLOCK) & (algorithm == "md5")
    at = np.flatnonzero(short)
    for i in range(0, len(at), TEXTS):
        part = at[i : i + TEXTS]
        out[part] = _md5(padded, begin[part], size[part])
    at, digest, held = np.flatnonzero(~short), getattr(hashlib, algorithm), memoryview(padded)
    out[at] = np.frombuffer(b"".join([digest(held[a:b]).digest()[:8] for a, b in zip(begin[at].tolist(), end[at].tolist())]), ">u8")
    return out


def _joined(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, a space after each, and where each begins, with the end."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text, letter = np.full(begin[-1], ord(" "), np.uint8), np.ones(begin[-1], bool)
    letter[begin[1:] - 1] = False
    if len(words):
        edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        text[letter] = np.frombuffer(words.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return text, begin


def _rows(values: list[np.ndarray], alone: int, bits: int, space: int) -> pa.RecordBatch:
    """Numbers of ``space`` bits, in 2^bits buckets by their first; ``alone`` goes with any."""
    found = np.sort(np.concatenate([*values, np.empty(0, np.uint64)]))
    lows = [b << (space - bits) for b in range(1 << bits)]
    edges = [*np.searchsorted(found, np.array(lows, np.uint64)), len(found)]
    rows = [(b, 0, packed(found[i:j], lows[b])) for b, (i, j) in enumerate(zip(edges, edges[1:])) if i < j]
    rows += [(0, alone, None)] if alone else []
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["bucket", "alone", "data"]) if rows else pa.RecordBatch.from_pylist([], pa.schema([("bucket", pa.int32()), ("alone", pa.int64()), ("data", pa.binary())]))


def _met(group: pa.Table, bits: int, space: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a bucket and how often each is there."""
    low = group["bucket"][0].as_py() << (space - bits)
    parts = [unpacked(x, low) for x in group["data"].to_pylist() if x]
    return np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]), return_counts=True)


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole media, and where each begins; the last waits for its other rows."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([held, table]) if held else table).combine_chunks()
        ids, null = table["media_id"].fill_null(0).to_numpy(), table["media_id"].is_null().to_numpy()
        starts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1).tolist()]
        held = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
    if held:
        yield held, [0, held.num_rows]


def _shingles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, list[np.ndarray], Callable[[int], Iterator[np.ndarray]]]]:
    """For each table of media: itself, the numbers of its shingles by size, and for a size
    the places of the distinct ones of each media."""
    for table, starts in _media(batches):
        words = table["words"].combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        lengths = words.value_lengths().to_numpy()
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(lengths.sum())
        of = numbers(words.flatten().to_numpy(zero_copy_only=False).view(np.uint64), most)
        cuts = np.concatenate([[0], ends])[starts]

        def places(k: int, left=left, of=of, cuts=cuts) -> Iterator[np.ndarray]:
            for a, b in zip(cuts, cuts[1:]):
                at = np.flatnonzero(left[a:b] >= k) + a
                if len(at):
                    yield at[np.unique(of[k][at], return_index=True)[1]]

        yield table, of, places


def _words(tokens: DataFrame, *also: str) -> DataFrame:
    return tokens.select("media_id", *also, F.transform("tokens", lambda w: F.xxhash64(w)).alias("words"))


def shared_filter(tokens: DataFrame, bits: int, config: FingerprintConfig = DEFAULT) -> tuple[Broadcast, int]:
    """A bitmap, and its bits, of the numbers of shortest shingles that may lie in several
    media. ``bits``: the logarithm of the number of buckets. Equal buckets are made on the
    executors; the driver puts 128 MB at most together."""
    least = min(config.shingle_sizes)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for _, of, places in _shingles(batches, least):
            for at in places(least):
                found.append(of[least][at] >> np.uint64(64 - SHORT))
                n += len(at)
            if n >= CHUNK:
                yield _rows(found, 0, bits, SHORT)
                found, n = [], 0
        yield _rows(found, 0, bits, SHORT)

    def several(group: pa.Table) -> pa.Table:
        values, counts = _met(group, bits, SHORT)
        values, bucket = values[counts > 1], group["bucket"][0].as_py()
        rows = [(bucket, len(values), packed(values, bucket << (SHORT - bits)))] if len(values) else []
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "alone": pa.array([r[1] for r in rows], pa.int64()), "data": pa.array([r[2] for r in rows], pa.binary())})

    met = materialise(_words(tokens).mapInArrow(first, _PACKED).groupBy("bucket").applyInArrow(several, _PACKED))
    members = met.agg(F.sum("alone")).first()[0] or 0
    size = min(MOST_BITS, max(LEAST_BITS, bits + 3, (16 * members).bit_length()))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist()):
                held = np.zeros(1 << (size - bits), np.uint8)
                held[((unpacked(data, bucket << (SHORT - bits)) >> np.uint64(SHORT - size)) - np.uint64(bucket << (size - bits))).astype(np.int64)] = 1
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["bucket", "bitmap"])

    whole, part = bytearray(1 << (size - 3)), 1 << (size - bits - 3)
    for row in met.mapInArrow(bitmaps, "bucket int, bitmap binary").toLocalIterator():
        whole[row.bucket * part : (row.bucket + 1) * part] = row.bitmap
    return tokens.sparkSession.sparkContext.broadcast(bytes(whole)), size


def _split(batches: Iterator[pa.RecordBatch], sizes: list[int], held: tuple[Broadcast, int]) -> Iterator[tuple[pa.Table, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each table of media: itself, and for each media and size k: k, the numbers at all
    places, and the places of what lies in it alone and of what may lie in others."""
    least, bitmap = min(sizes), np.frombuffer(held[0].value, np.uint8)
    for table, of, places in _shingles(batches, max(sizes)):
        at = of[least] >> np.uint64(64 - held[1])
        maybe = (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

        def each(of=of, places=places, maybe=maybe):
            for k in sizes:
                for at in places(k):
                    both = np.logical_and.reduce([maybe[at + j] for j in range(k - least + 1)])
                    yield k, of[k], at[~both], at[both]

        yield table, each()


def frequency_counts(tokens: DataFrame, bits: int, config: FingerprintConfig = DEFAULT) -> DataFrame:
    """df, k: how many shingles have each frequency, in several rows. Shingles are told
    apart by numbers of 64 bits, as many as their hashes have."""
    held, sizes = shared_filter(tokens, bits, config), sorted({k for k in config.shingle_sizes if k > 0})

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, alone = [], 0, 0
        for _, each in _split(batches, sizes, held):
            for _, of, single, shared in each:
                found.append(of[shared])
                n, alone = n + len(shared), alone + len(single)
            if n >= CHUNK:
                yield _rows(found, alone, bits, 64)
                found, n, alone = [], 0, 0
        yield _rows(found, alone, bits, 64)

    return _counts(_words(tokens).mapInArrow(second, _PACKED), bits)


def _counts(rows: DataFrame, bits: int) -> DataFrame:
    """df, k from packed numbers and how many are alone."""

    def counted(group: pa.Table) -> pa.Table:
        df, k = np.unique(_met(group, bits, 64)[1], return_counts=True)
        alone = sum(group["alone"].to_pylist())
        return pa.table({"df": pa.array([1, *df.tolist()], pa.int64()), "k": pa.array([alone, *k.tolist()], pa.int64())})

    return rows.groupBy("bucket").applyInArrow(counted, "df long, k long").where("k > 0")


def document_frequency(tokens: DataFrame, bits: int, config: FingerprintConfig = DEFAULT) -> DataFrame:
    """hash (a number, see ``fingerprint.packed``), df: the media that hold each. What lies in
    one media is hashed and told where it lies, the rest in the branch that shuffles."""
    return frequency_and_counts(tokens, bits, config)[0]


def frequency_and_counts(tokens: DataFrame, bits: int, config: FingerprintConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``document_frequency``, and ``frequency_counts`` of its hashes: a query that reads both
    shuffles the hashes once."""
    held, sizes = shared_filter(tokens, bits, config), sorted({k for k in config.shingle_sizes if k > 0})
    rows = _words(tokens, "tokens")

    def hashes(batches: Iterator[pa.RecordBatch], alone: bool) -> Iterator[tuple[np.ndarray, int]]:
        """Those of one kind, and how many of the other there are."""
        for table, each in _split(batches, sizes, held):
            tokens = table["tokens"].combine_chunks()
            text, begin = _joined((tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens).flatten().cast(pa.binary()))
            none = np.empty(0, np.int64)
            first, last, others = [none], [none], 0
            for k, _, single, shared in each:
                at, rest = (single, shared) if alone else (shared, single)
                at, others = np.sort(at), others + len(rest)
                first.append(begin[at])
                last.append(begin[at + k] - 1)
            yield digests(text, np.concatenate(first), np.concatenate(last), config.hash_algorithm), others

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, _ in hashes(batches, True):
            for i in range(0, len(found), 1 << 16):
                part = found[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(np.ones(len(part), np.int64))], ["hash", "df"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, alone = [], 0, 0
        for x, others in hashes(batches, False):
            found.append(x)
            n, alone = n + len(x), alone + others
            if n >= CHUNK:
                yield _rows(found, alone, bits, 64)
                found, n, alone = [], 0, 0
        yield _rows(found, alone, bits, 64)

    def counted(group: pa.Table) -> pa.Table:
        hash, df = _met(group, bits, 64)
        return pa.table({"hash": pa.array(hash.view(np.int64)), "df": pa.array(df.astype(np.int64))})

    sent = rows.mapInArrow(shared, _PACKED)
    told = sent.groupBy("bucket").applyInArrow(counted, "hash long, df long")
    return rows.mapInArrow(single, "hash long, df long").unionByName(told), _counts(sent, bits)
