"""Byte-pair merges of many words at once, on arrays."""

from __future__ import annotations

import json

import numpy as np

NEVER = np.int32(2**31 - 1)
#: Words longer than this many symbols are left to the caller.
LONGEST = 64
#: Below this id, ranks of pairs lie in a plain table.
DENSE = 512


class MergeTable:
    """Ranked merges of a tokenizer file.

    ``merge`` takes the words of a batch as rows of symbol ids and repeats, for every
    row, the merge of the lowest rank, the leftmost among equals, until none is left.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 32 | right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.dense = np.full((DENSE, DENSE), NEVER, np.int32)
        low = (left < DENSE) & (right < DENSE)
        self.dense[left[low], right[low]] = np.flatnonzero(low)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; pairs with a negative id or without a merge have none."""
        out = np.full(left.shape, NEVER, np.int32)
        real = (left >= 0) & (right >= 0)
        low = real & (left < DENSE) & (right < DENSE)
        out[low] = self.dense[left[low], right[low]]
        high = real & ~low
        if high.any():
            keys = left[high].astype(np.int64) << 32 | right[high]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out[high] = np.where(self.keys[at] == keys, self.order[at], NEVER)
        return out

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of ids, filled up with -1 at the end, after all merges."""
        out = symbols
        rows = np.arange(len(symbols))
        now = symbols.copy()
        rank = self.ranks(now[:, :-1], now[:, 1:])
        columns = np.arange(now.shape[1])
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), int)
            each = np.arange(len(rows))
            best = rank[each, at] if rank.shape[1] else np.full(len(rows), NEVER)
            live = best < NEVER
            if not live.all():
                out[rows[~live]] = now[~live]
                rows, now, rank, at, best = rows[live], now[live], rank[live], at[live], best[live]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            now[each, at] = self.made[best]
            shifted = np.concatenate([now[:, 1:], np.full((len(rows), 1), -1, now.dtype)], 1)
            now = np.where(columns > at[:, None], shifted, now)
            shifted = np.concatenate([rank[:, 1:], np.full((len(rows), 1), NEVER, rank.dtype)], 1)
            rank = np.where(columns[:-1] >= at[:, None], shifted, rank)
            after = at < rank.shape[1]
            rank[each[after], at[after]] = self.ranks(now[each[after], at[after]], now[each[after], at[after] + 1])
            before = at > 0
            rank[each[before], at[before] - 1] = self.ranks(now[each[before], at[before] - 1], now[each[before], at[before]])
        return out

    def encode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
        """Ids (little-endian unsigned 32-bit) of words given as one run of symbol ids and the words' sizes; None where a word is longer than LONGEST."""
        starts = np.cumsum(sizes) - sizes
        out: list[bytes | None] = [None] * len(sizes)
        width = 4
        low = -1
        while width <= LONGEST:
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            if len(some):
                place = starts[some, None] + np.arange(width)
                real = np.arange(width) < sizes[some, None]
                merged = self.merge(np.where(real, flat[np.where(real, place, 0)], -1).astype(np.int32))
                counts = (merged >= 0).sum(1)
                raw = merged[merged >= 0].astype("<u4").tobytes()
                ends = np.cumsum(counts) * 4
                for k, a, b in zip(some.tolist(), (ends - counts * 4).tolist(), ends.tolist(), strict=True):
                    out[k] = raw[a:b]
            low, width = width, width * 2
        return out
