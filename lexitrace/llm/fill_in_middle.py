"""Fill-in-the-middle: cut a text into prefix, middle and suffix, and write it in an order
in which a model learns to fill the middle in.

The ends of the units (lines) of a batch of texts are ones in a packed bitvector over its
bytes, with a directory of the ones before each block of 512 bits. The ones between the
ends of a text are its number of units; a cut behind r units is found by ``select`` of the
r-th of them; ``rank`` in a second bitvector, of the first bytes of characters, counts code
points. A text costs two bits a byte and two look-ups, whatever its length.

Batches are cut at ``BATCH_BYTES`` of text, so memory is bounded by that or by the longest
text. Digits of a seeded sha256 of the identifier decide form and cuts, so results depend
on the rows alone.

Defined results: null text is empty; empty texts and those that hold a sentinel are plain.
A null identifier is hashed as the text 'null'. Rows that repeat an identifier get the same
digits. A text without a line end is one unit. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SEED, FIM_PERCENT, SPM_PERCENT = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BATCH_BYTES = 8 << 20
BLOCK_WORDS = 8  # of 64 bits


class Bits:
    """A packed bitvector with rank and select over arrays of questions."""

    def __init__(self, flags: np.ndarray) -> None:
        packed = np.packbits(flags, bitorder="little")
        room = np.zeros((len(packed) // (8 * BLOCK_WORDS) + 1) * 8 * BLOCK_WORDS, np.uint8)
        room[: len(packed)] = packed
        self.blocks = room.view("<u8").reshape(-1, BLOCK_WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones at places below each of ``at``."""
        block, bit = at // (64 * BLOCK_WORDS), at % (64 * BLOCK_WORDS)
        whole = np.arange(BLOCK_WORDS)[None, :] * 64
        kept = np.clip(bit[:, None] - whole, 0, 64)
        mask = np.where(kept == 64, np.uint64(2**64 - 1), (np.uint64(1) << kept.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, from 1, for each of ``k``, all of which exist."""
        block = np.searchsorted(self.before, k, side="left") - 1
        bits = np.unpackbits(self.blocks[block].view(np.uint8), axis=1, bitorder="little")
        inside = np.argmax(np.cumsum(bits, axis=1, dtype=np.int16) >= (k - self.before[block])[:, None], axis=1)
        return block * 64 * BLOCK_WORDS + inside


def cut(data: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
    """Of texts that lie one behind another in ``data`` and end at ``ends``: n, the places
    ``low`` and ``high`` of the two cuts, and the code points before and between them."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    flags = data == 10
    flags[ends[ends > starts] - 1] = True  # the last unit of a text needs no line end
    units, points = Bits(flags), Bits((data & 0xC0) != 0x80)
    before = units.rank(starts)
    n = units.rank(ends) - before
    out = {"n": n, "start": starts, "end": ends}
    first, second = h1 % (n + 1), h2 % (n + 1)
    for name, r in (("low", np.minimum(first, second)), ("high", np.maximum(first, second))):
        place = starts.copy()
        some = r > 0
        place[some] = units.select(before[some] + r[some]) + 1
        out[name] = place
    at = {k: points.rank(out[k]) for k in ("start", "low", "high")}
    return out | {"prefix_chars": at["low"] - at["start"], "middle_chars": at["high"] - at["low"]}


def batches_of(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with ``limit`` bytes of text, or one text."""
    offsets = np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset :][: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def digits(id_col: str, seed: int, k: int) -> Column:
    """The k-th group, from 1, of eight hexadecimal digits of the seeded hash, as a number."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(hashed, 8 * k - 7, 8), 16, 10).cast("long")


MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (digits(id_col, seed, 3) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(digits(id_col, seed, 4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), form.alias("form"), digits(id_col, seed, 1).alias("h1"), digits(id_col, seed, 2).alias("h2"))
    kind = dict(rows.dtypes)["doc_id"]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, batch_bytes):
                column = batch.column("text")
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
                body = column.buffers()[2] if offsets[-1] > offsets[0] else None
                data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
                found = cut(data, offsets[1:] - offsets[0], *(batch.column(h).to_numpy() for h in ("h1", "h2")))
                forms, raw, out = batch.column("form").to_pylist(), data.tobytes(), []
                for form, a, low, high, b in zip(forms, *(found[k].tolist() for k in ("start", "low", "high", "end"))):
                    if form == "plain":
                        out.append(raw[a:b])
                    elif form == "psm":
                        out.append(b"".join((p, raw[a:low], s, raw[high:b], m, raw[low:high])))
                    else:
                        out.append(b"".join((s, raw[high:b], p, raw[a:low], m, raw[low:high])))
                none = np.array([f == "plain" for f in forms])
                chars = [pa.array(found[k], pa.int64(), mask=none) for k in ("prefix_chars", "middle_chars")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found["n"], pa.int64()), batch.column("form"), *chars, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", *[x.split()[0] for x in MADE.split(", ")]])

    return rows.mapInArrow(made, f"doc_id {kind}, {MADE}")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given: texts that hold a sentinel are plain, so
    the sentinels of the others are their only ones."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second, middle = (F.get(part, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
x AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM x),
s AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM s
"""
