"""Benchmark decontamination by suffix arrays over shards of the training texts.

Every task turns its documents into shards: the words of many documents as numbers of
one vocabulary, that of the benchmark, 0 standing for any other word and for the end of
a document. Runs of benchmark words that are too short for the shortest window are left
out, since no match can lie in them; over the rest stands a suffix array. All suffixes of
the benchmark items are then searched in it by bisection, word by word and all at once,
which gives the places of every window and the longest verbatim match of every suffix.

The benchmark reaches the tasks in blocks of bounded size; a larger benchmark takes
several passes. A document lies in one shard with all its words, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.llm.common import ceil_div, staged, text_slices, words_table

#: Words of a window.
WINDOW = 13
#: Characters of benchmark texts that one pass hands to the tasks.
BLOCK_CHARS = 16_000_000
#: Bytes of text of a shard, and those split into words at once.
SHARD_BYTES = 8 << 20
LETTERS = words_table(b"0123456789abcdefghijklmnopqrstuvwxyz")
FOUND = "dc_words long, dc_hits array<struct<start:long,end:long>>, dc_items array<string>"
LONGEST = "item_id string, item_start long, length long, doc_id long, doc_start long"


def word_parts(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text (lower-cased; digits, letters and all beyond ASCII), a bounded part at a time."""
    raw = (text or "").encode().translate(LETTERS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SHARD_BYTES) if len(raw) - at > SHARD_BYTES else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


@dataclass
class TestBlock:
    """Benchmark items as numbers, and all their suffixes that start a window."""

    vocab: dict[bytes, int] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    def fill(self, rows: list[tuple], window: int) -> TestBlock:
        words, item, offset, left, needed = [np.zeros(0, np.int32)], [], [], [], []
        for item_id, text in rows:
            own = [w for part in word_parts(text) for w in part]
            if not own:
                continue
            k = len(self.names)
            self.names.append("" if item_id is None else str(item_id))
            words.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in own], np.int32))
            need = min(window, len(own))
            starts = np.arange(len(own) - need + 1)
            item.append(np.full(len(starts), k))
            offset.append(starts)
            left.append(len(own) - starts)
            needed.append(np.full(len(starts), need))
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.words = np.concatenate(words)
        sizes = np.array([len(w) for w in words[1:]], np.int64)
        self.item, self.offset, self.left, self.needed = map(join, (item, offset, left, needed))
        self.start = (np.cumsum(sizes) - sizes)[self.item] + self.offset if len(sizes) else self.item
        self.least = int(self.needed.min()) if len(self.needed) else 0
        self.deepest = int(self.left.max()) if len(self.left) else 0
        return self


class Shard:
    """Suffix array over the benchmark words of some documents."""

    def __init__(self, ids: np.ndarray, block: TestBlock):
        edges = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        enough = ends - starts >= block.least
        starts, ends = starts[enough], ends[enough]
        sizes = ends - starts + 1  # the word behind a run is a 0
        total = int(sizes.sum())
        self.place = np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        self.words = np.concatenate([ids, [0]])[self.place].astype(np.int64)
        rank = np.unique(self.words, return_inverse=True)[1] if total else self.words
        reach, top = 1, int(rank.max()) + 1 if total else 1
        while total and reach < block.deepest and top < total:  # doubling, as deep as a match can go
            behind = np.concatenate([rank[reach:] + 1, np.zeros(min(reach, total), rank.dtype)])[:total]
            rank = np.unique(rank * (top + 1) + behind, return_inverse=True)[1]
            reach, top = 2 * reach, int(rank.max()) + 1
        self.order = np.argsort(rank, kind="stable")

    def search(self, block: TestBlock) -> tuple[np.ndarray, ...]:
        """For each suffix of the block: the interval of its window (empty: nowhere), its longest match and one interval of that."""
        n = len(block.start)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order))
        window_low, window_high, longest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        last_low, last_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(high > 0)
        for depth in range(block.deepest):
            live = live[block.left[live] > depth]
            if not len(live):
                break
            want = block.words[block.start[live] + depth]
            first = self._bound(low[live], high[live], depth, want, 0)
            after = self._bound(first, high[live], depth, want, 1)
            low[live], high[live] = first, after
            live = live[after > first]
            longest[live] = depth + 1
            last_low[live], last_high[live] = low[live], high[live]
            reached = live[block.needed[live] == depth + 1]
            window_low[reached], window_high[reached] = low[reached], high[reached]
        return window_low, window_high, longest, last_low, last_high

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray, past: int) -> np.ndarray:
        """First place in [low, high) whose word at ``depth`` is not below ``want + past``."""
        low, high = low.copy(), high.copy()
        want = want + past
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = self.order[np.minimum(mid, len(self.order) - 1)] + depth
            less = np.where(at < len(self.words), self.words[np.minimum(at, len(self.words) - 1)], 0) < want
            low = np.where(open_ & less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low


def numbered(texts: list[str | None], block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers, each text followed by a 0; the number of words of each text."""
    parts, sizes = [], []
    for text in texts:
        own = [np.fromiter(map(block.vocab.get, words, repeat(0)), np.int32, len(words)) for words in word_parts(text)]
        sizes.append(sum(map(len, own)))
        parts += [*own, np.zeros(1, np.int32)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(sizes, np.int64)


def found_in(texts: list[str | None], block: TestBlock) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    """Of each text: words, hit ranges that neither meet nor overlap, ids of items with windows in it."""
    ids, sizes = numbered(texts, block)
    ends = np.cumsum(sizes + 1)
    base = ends - sizes - 1
    hits: list[list[dict]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if block.least:
        shard = Shard(ids, block)
        low, high, *_ = shard.search(block)
        hit = np.zeros(len(ids) + 1, np.int32)
        some = np.flatnonzero(high > low)
        groups: dict[tuple, list[int]] = {}  # items that share a window share its places
        for k, key in zip(some.tolist(), zip(low[some].tolist(), high[some].tolist(), block.needed[some].tolist(), strict=True), strict=True):
            groups.setdefault(key, []).append(k)
        for (a, b, need), tests in groups.items():
            at = shard.place[shard.order[a:b]]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + need, -1)
            names = {block.names[k] for k in block.item[tests].tolist()}
            for d in np.unique(np.searchsorted(ends, at, side="right")).tolist():
                items[d] |= names
        edges = np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8)]))
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            d = int(np.searchsorted(ends, a, side="right"))
            hits[d].append({"start": a - int(base[d]), "end": b - int(base[d])})
    return sizes, hits, [sorted(x) for x in items]


def joined_ranges(ranges: list[dict]) -> list[dict]:
    """Ranges put together where they meet or overlap."""
    out: list[dict] = []
    for r in sorted(ranges, key=lambda r: r["start"]):
        if out and r["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], r["end"])
        else:
            out.append(dict(r))
    return out


def blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[TestBlock]:
    """The benchmark (item_id, text) in blocks of about ``BLOCK_CHARS`` characters; at least one, empty or not."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, ceil_div(chars, BLOCK_CHARS))
    for k in range(n):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield TestBlock().fill(list(zip(*(c.to_pylist() for c in rows.columns), strict=True)), window)


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row with its words (``dc_words``), hit ranges (``dc_hits``) and the items found (``dc_items``).

    An item of fewer than ``window`` words is one window; an item without words has none. NULL and
    empty texts have no words. Repeated rows and items are kept as they are; a NULL item_id
    counts as an empty one. Input columns named like the three new ones are replaced.
    """
    spark = docs.sparkSession
    out = docs.drop("dc_words", "dc_hits", "dc_items")
    width, place = len(out.columns), out.columns.index("text")
    schema = StructType([*out.schema.fields, *StructType.fromDDL(FOUND).fields])
    for k, block in enumerate(blocks(benchmark, window)):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=k > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, stop in text_slices(batch.column(place), SHARD_BYTES):
                    part = batch.slice(start, stop - start)
                    sizes, hits, items = found_in(part.column(place).to_pylist(), shared.value)
                    if again:
                        hits = [joined_ranges([*a, *b]) for a, b in zip(hits, part.column(width + 1).to_pylist(), strict=True)]
                        items = [sorted({*a, *b}) for a, b in zip(items, part.column(width + 2).to_pylist(), strict=True)]
                    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
                    columns = [*part.columns[:width], pa.array(sizes), pa.array(hits, kinds[0]), pa.array(items, kinds[1])]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        out = (staged(out, "decontamination") if k else out).mapInArrow(run, schema)
    return out


def n_hit() -> F.Column:
    return F.aggregate("dc_hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def contaminated() -> F.Column:
    """Hit words make a twentieth of the document, or more."""
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("dc_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    return annotate(docs, benchmark, window).where(~contaminated()).select(*[F.col(f"`{c}`") for c in docs.columns])


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per item found anywhere: its longest verbatim match of a window or more, and a place of it.

    Ties go to the smallest document, then the first place in it and in the item.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts = []
    for block in blocks(benchmark, window):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            test = shared.value
            for batch in batches:
                for start, stop in text_slices(batch.column(1), SHARD_BYTES) if test.least else ():
                    part = batch.slice(start, stop - start)
                    ids, sizes = numbered(part.column(1).to_pylist(), test)
                    ends, doc_ids = np.cumsum(sizes + 1), part.column(0).to_pylist()
                    shard = Shard(ids, test)
                    _, _, longest, low, high = shard.search(test)
                    best: dict[str, tuple] = {}
                    for k in np.flatnonzero(longest >= test.needed).tolist():
                        name, at = test.names[test.item[k]], shard.place[shard.order[low[k] : high[k]]]
                        if name in best and best[name][0] > longest[k]:
                            continue
                        docs_at = np.searchsorted(ends, at, side="right")
                        places = [(doc_ids[d] is None, doc_ids[d] or 0, int(p - (ends[d] - sizes[d] - 1))) for d, p in zip(docs_at.tolist(), at.tolist(), strict=True)]
                        null, doc_id, doc_start = min(places)
                        new = (int(longest[k]), (null, doc_id, doc_start, int(test.offset[k])))
                        if name not in best or new[0] > best[name][0] or new[1] < best[name][1]:
                            best[name] = new
                    got = [{"item_id": name, "item_start": o, "length": n, "doc_id": None if null else d, "doc_start": s} for name, (n, (null, d, s, o)) in best.items()]
                    yield pa.RecordBatch.from_pylist(got, schema=pa.schema([("item_id", pa.string()), *[(c, pa.int64()) for c in ("item_start", "length", "doc_id", "doc_start")]]))

        parts.append(rows.mapInArrow(run, LONGEST))
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    order = F.struct(-F.col("length"), F.col("doc_id").isNull(), "doc_id", "doc_start", "item_start")
    best = found.groupBy("item_id").agg(F.min_by(F.struct("item_start", "length", "doc_id", "doc_start"), order).alias("m"))
    return best.select("item_id", "m.*")


def contract(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return annotate(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("dc_items")), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )
