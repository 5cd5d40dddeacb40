"""SentencePiece encoding and decoding by Viterbi search over an Aho-Corasick automaton.

The automaton over all ordinary pieces reads a text once; at each end position its
output links list the pieces that end there, and each relaxes the best score of that
position. Scores add up; of equal scores the segmentation with fewer pieces wins, then
the one whose last piece is longest. A character that no piece covers alone costs the
least score less ten and becomes byte pieces.

No piece of the model holds a space after another character (checked when it is read),
so the best path splits before each run of spaces, and best paths of short stretches
are kept in two generations of bounded size: when the younger is full, the older goes,
so frequent stretches stay. A worker process builds one codec and keeps it for its later
tasks. A text gets one leading space, as the
model's own normaliser does; a literal U+2581 is spelled in bytes, so decoding gives
back every text exactly.

Defined results: null and empty texts have no ids and decode to ''. Repeated rows give
equal rows; an empty table gives none; extra columns are not read. The model (its size
is fixed) travels to the executors as bytes, so they need no file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches of up to so many characters are kept, and so many of them in a generation.
KEPT_LENGTH, KEPT = 48, 100_000
#: Rows are handed on when they hold so many ids.
SLICE = 1 << 20


class Codec:
    """Encoder and decoder of one SentencePiece model (its serialised bytes)."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text, self.byte, self.by_byte = {}, {}, {}
        self.trie = ahocorasick.Automaton()
        scores, single, inner = [], set(), False
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[i] = int(piece[3:5], 16)
                self.by_byte[self.byte[i]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = piece.replace("▁", " ")
                self.text[i] = piece
                scores.append(sp.get_score(i))
                self.trie.add_word(piece, (len(piece), sp.get_score(i), i))
                inner |= " " in piece.lstrip(" ")
                if len(piece) == 1:
                    single.add(piece)
        self.trie.make_automaton()
        self.single, self.unknown = single, min(scores) - 10.0
        alphabet = set("".join(self.text.values()))
        free = "".join(c for c in "\n\t" if c not in alphabet)
        self.cut = None if inner else re.compile(f" *[^ {free}]+|[{free}]| +" if free else " *[^ ]+| +")
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def best_path(self, part: str) -> list[int]:
        """Piece ids of the best segmentation of ``part``; uncovered characters in bytes."""
        n, low = len(part), -float("inf")
        score, count, back, made = [low] * (n + 1), [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0], done = 0.0, 0
        holes = [] if self.single.issuperset(part) else [k for k in range(n) if part[k] not in self.single]
        links = self.trie.iter(part)
        if holes:
            links = sorted([*links, *((k, (1, self.unknown, -1)) for k in holes)], key=lambda x: x[0])
        for last, (length, cost, piece) in links:
            end = last + 1
            start = end - length
            s, c = score[start] + cost, count[start] + 1
            best = score[end]
            if s > best or s == best and (c < count[end] or c == count[end] and length > back[end]):
                score[end], count[end], back[end], made[end] = s, c, length, piece
        out, at = [], n
        while at:
            if made[at] >= 0:
                out.append(made[at])
            else:
                out.extend(self.by_byte[b] for b in reversed(part[at - 1].encode("utf-8", "surrogatepass")))
            at -= back[at]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = f" {text}"
        if self.cut is None:
            return self.best_path(text)
        out, kept = [], self.kept
        for part in self.cut.findall(text):
            ids = kept.get(part)
            if ids is None:
                ids = self.older.get(part) or tuple(self.best_path(part))
                if len(part) <= KEPT_LENGTH:
                    if len(kept) >= KEPT:
                        self.older, self.kept = kept, {}
                        kept = self.kept
                    kept[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        if not len(ids):
            return ""
        out, run = [], bytearray()
        byte, text = self.byte, self.text
        for i in ids:
            if i in byte:
                run.append(byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(text.get(i, ""))
        out.append(run.decode("utf-8", "replace"))
        whole = "".join(out)
        return whole[1:] if whole.startswith(" ") else whole


@lru_cache(maxsize=1)
def codec_of(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_column(model: bytes, text_col: str = "text"):
    """A column of token ids."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(model)
        for batch in texts:
            yield batch.map(codec.encode, na_action=None)

    return ids(F.coalesce(F.col(text_col), F.lit("")))


def decode_column(model: bytes, ids_col: str = "token_ids"):
    """A column of texts from token ids; null ids decode to ''."""

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(model)
        for batch in ids:
            yield batch.map(lambda x: "" if x is None else codec.decode(x), na_action=None)

    return text(F.col(ids_col))


def encode_and_check(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = (), slice_ids: int = SLICE) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded_sha256 (of what the ids decode to) and
    round_trip (whether that is the text), then the columns ``also`` as they are. One
    pass over the texts."""

    def new_rows() -> dict[str, list]:
        return {"n_tokens": [], "token_ids": [], "decoded_sha256": [], "round_trip": []}

    @F.pandas_udf("n_tokens long, token_ids array<int>, decoded_sha256 string, round_trip boolean")
    def codes(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(model)
        for batch in texts:
            # Ids take four bytes each; a batch of long texts is handed on in slices.
            out, held = new_rows(), 0
            for text in batch:
                ids = codec.encode(text)
                back = codec.decode(ids)
                out["n_tokens"].append(len(ids))
                out["token_ids"].append(np.array(ids, np.int32))
                out["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                out["round_trip"].append(back == text)
                held += len(ids)
                if held >= slice_ids:
                    yield pd.DataFrame(out)
                    out, held = new_rows(), 0
            if out["n_tokens"]:
                yield pd.DataFrame(out)

    return docs.select(F.col(id_col).alias("doc_id"), codes(F.coalesce(F.col(text_col), F.lit(""))).alias("c"), *also).select("doc_id", "c.*", *also)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(table(spark, sf_dir, "documents"), read_model())
