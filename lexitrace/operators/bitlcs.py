"""Longest common subsequences of many pairs at once, bit-parallel over 64-bit words.

A row pairs one stream with a list of queries. The pairs of an Arrow batch go through
their streams in step: bit i of a pair's state is 0 where the length of the match grows at
place i of its query, and one addition a word moves all pairs on by a token. Only tokens
that query and stream share are steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of masks that are held before they are worked off: 32 MB.
HELD = 4 << 20
#: Query places times their occurrences that one expansion makes at most, but for one pair.
EXPANDED = 2 << 20
SHAPE = "query_id long, media_id long, match_count long, query_count long, win_start long, win_end long"
COLUMNS = [x.split()[0] for x in SHAPE.split(", ")]


def lengths(masks: np.ndarray, steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of pairs whose masks (steps x words) lie one behind another, ``steps`` for each, the
    lengths of their longest common subsequences; ``sizes`` are those of the queries."""
    order = np.argsort(-steps, kind="stable")
    first = (np.cumsum(steps) - steps)[order]
    left, width = steps[order], masks.shape[1]
    state = np.full((len(steps), width), np.uint64(2**64 - 1))
    alive = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
    for t, n in enumerate(alive.tolist()):
        mask, v = masks[first[:n] + t], state[:n]
        carry = np.zeros(n, np.uint64)
        for w in range(width):
            u = v[:, w] & mask[:, w]
            total = v[:, w] + u
            more = total < u
            total += carry
            if width > 1:
                carry = (more | (total < carry)).astype(np.uint64)
            state[:n, w] = total | (v[:, w] & ~mask[:, w])
    bits = np.clip(sizes[order][:, None] - 64 * np.arange(width)[None, :], 0, 64).astype(np.uint64)
    inside = np.where(bits == 64, np.uint64(2**64 - 1), (np.uint64(1) << bits % np.uint64(64)) - np.uint64(1))
    out = np.empty(len(steps), np.int64)
    out[order] = np.bitwise_count(~state & inside).sum(axis=1)
    return out


class Pairs:
    """Pairs of a batch, held as masks by the number of words of their queries."""

    def __init__(self) -> None:
        self.held: dict[int, list] = {}
        self.size = 0

    def add(self, width: int, ids: np.ndarray, steps: np.ndarray, masks: np.ndarray) -> None:
        self.held.setdefault(width, []).append((ids, steps, masks))
        self.size += masks.size

    def work_off(self, sizes: np.ndarray, out: np.ndarray) -> None:
        for parts in self.held.values():
            ids, steps, masks = (np.concatenate([p[k] for p in parts]) for k in range(3))
            out[ids] = lengths(masks, steps, sizes[ids])
        self.held, self.size = {}, 0


def places(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each entry's code came before in the same owner's list."""
    order = np.lexsort((np.arange(len(codes)), codes, owner))
    new = np.ones(len(codes), bool)
    new[1:] = (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    at = np.arange(len(codes))
    out = np.empty(len(codes), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def row_pairs(stream: np.ndarray, codes: np.ndarray, owner: np.ndarray, spot: np.ndarray, least: np.ndarray, base: int, pairs: Pairs, first: np.ndarray, last: np.ndarray) -> None:
    """Pairs of one stream: ``codes`` are the tokens of its queries, ``owner`` and ``spot`` the
    query and the place of each. Pairs that share fewer tokens than ``least``, counted with
    repeats, bound the length from above and are left out."""
    order = np.argsort(stream, kind="stable")
    known = stream[order]
    low, high = np.searchsorted(known, codes, "left"), np.searchsorted(known, codes, "right")
    shared = np.bincount(owner, (places(codes, owner) < high - low).astype(float), len(least)).astype(np.int64)
    good = (shared >= np.maximum(least, 1))[owner] & (high > low)
    owner, spot, low, times = owner[good], spot[good], low[good], (high - low)[good]
    if not len(owner):
        return
    # Whole pairs at a time, as many as EXPANDED allows.
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    until, total = np.r_[begin[1:], len(owner)], np.cumsum(times)
    k = 0
    while k < len(begin):
        room = total[begin[k] - 1] + EXPANDED if begin[k] else EXPANDED
        m = max(k + 1, int(np.searchsorted(total[until - 1], room, side="right")))
        part = slice(begin[k], until[m - 1])
        n = times[part]
        where = order[np.repeat(low[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        who, bit = np.repeat(owner[part], n), np.repeat(spot[part], n)
        turn = np.lexsort((where, who))
        where, who, bit = where[turn], who[turn], bit[turn]
        new = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (who[1:] != who[:-1])])
        width = int(bit.max()) // 64 + 1
        one = np.uint64(1) << (bit % 64).astype(np.uint64)
        masks = np.stack([np.bitwise_or.reduceat(np.where(bit // 64 == w, one, np.uint64(0)), new) for w in range(width)], axis=1)
        ids, heads, steps = np.unique(who[new], return_index=True, return_counts=True)
        first[base + ids], last[base + ids] = where[new][heads], where[new][heads + steps - 1]
        pairs.add(width, base + ids, steps, masks)
        k = m


def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of media_id, tokens, starts, asked (list of query_id, tokens, least) as rows of
    ``SHAPE``, for pairs that share ``least`` tokens and one at least."""
    for batch in batches:
        tokens, asked, starts = batch.column("tokens"), batch.column("asked"), batch.column("starts")
        query, words = asked.flatten(), asked.flatten().field("tokens")
        told = pa.concat_arrays([tokens.flatten(), words.flatten()]).dictionary_encode()
        codes = told.indices.to_numpy()
        s_at = np.r_[0, np.cumsum(tokens.value_lengths().to_numpy())]
        a_at = np.r_[0, np.cumsum(asked.value_lengths().to_numpy())]
        sizes = words.value_lengths().to_numpy().astype(np.int64)
        q_at = s_at[-1] + np.r_[0, np.cumsum(sizes)]
        least = query.field("least").to_numpy(zero_copy_only=False).astype(np.int64)
        found, pairs = np.zeros(len(sizes), np.int64), Pairs()
        first, last = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for r in range(batch.num_rows):
            a, b = a_at[r], a_at[r + 1]
            n = sizes[a:b]
            owner = np.repeat(np.arange(b - a), n)
            spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row_pairs(codes[s_at[r] : s_at[r + 1]], codes[q_at[a] : q_at[b]], owner, spot, least[a:b], a, pairs, first, last)
            if pairs.size >= HELD:
                pairs.work_off(sizes, found)
        pairs.work_off(sizes, found)
        kept = np.flatnonzero((found >= np.maximum(least, 1)))
        row = np.repeat(np.arange(batch.num_rows), np.diff(a_at))[kept]
        clock = starts.flatten().to_numpy(zero_copy_only=False)
        media = batch.column("media_id").to_numpy(zero_copy_only=False)[row]
        ids = query.field("query_id").take(pa.array(kept))
        yield pa.RecordBatch.from_arrays([ids, pa.array(media), *map(pa.array, (found[kept], sizes[kept], clock[s_at[row] + first[kept]], clock[s_at[row] + last[kept]]))], COLUMNS)
