"""Similarity join on word n-grams, and its classes.

Sets of shingles link when their Jaccard similarity reaches a bound. Three steps lose no link:

1. Cells. The range of hashes is cut into k parts, k following from the size class of a set.
   Two sets that link differ in at most D shingles, so at least m = k - D parts are the same
   in both. Each set enters the inverted list of each of its parts (a 64-bit digest of the part).
   By the T-occurrence argument a set may leave out its m - 1 longest lists: the shortest
   of at least m common lists is then still with both. Sets that share a list that both kept
   fall in one cell. A passage that many documents hold makes long lists, and these are
   what is left out, so it ties nothing together.
2. Links. The sets of a cell go to one task, or, for a large cell, in blocks so that every pair of
   blocks meets in one task. There a T-occurrence search runs over inverted lists of
   shingles (DivideSkip): the short lists of a set are merged, sets with too few hits are
   dropped, and the rest are probed by bisection in the long lists, hits deciding exactly.
   Sets already in the same class need no further link. Links that span the classes come out.
3. Classes: connected components of the links. Equal sets were put together before.

Shingles stand for their 64-bit hashes; a set for the 128-bit digest of them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import components, staged, text_slices
from assayer.llm.quality import word_parts

#: Documents whose parts share a bucket of lists, and entries that a task gathers before it gives them out.
BUCKET_DOCUMENTS = 5_000
GATHERED = 1 << 20
#: A list longer than HOT, found when a bucket has grown past MOST_HELD entries, is passed on at once as the longest of all.
MOST_HELD = 1 << 22
HOT = 100_000
HOT_LENGTH = 2**31 - 1
#: Shingles of a block of a cell.
BLOCK_SHINGLES = 1_500_000
#: Shares of text bytes worked on at once.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words none."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part)) for part in word_parts((text or ""), lower=True)]
    own = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = min(words, len(own))
    if not n:
        return own
    out = np.full(len(own) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - n + 1 + k]
    return np.unique(mix(out))


def needed(a, b, percent: int):
    """Least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


@lru_cache(maxsize=8)
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest size, number of parts k, and parts m that linked sets have in common, per size class."""
    tops = [4]
    while tops[-1] < 2**40:
        tops.append(max(tops[-1] * 3 // 2, tops[-1] * 100 // percent) + 1)
    top = np.array(tops, np.int64)
    most = 2 * top * (100 - percent) // (100 + percent)
    same = 1 + (most + 1) // 6
    return top, most + same, same


def signatures(own: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, int]]:
    """For the set's class and, where a partner may lie in it, the next: digests of its parts, and class and lists to leave out as one number."""
    top, parts, same = size_classes(percent)
    first = int(np.searchsorted(top, len(own)))
    spread = mix(own)
    for cls in range(first, first + 1 + (len(own) * 100 // percent > top[first])):
        k, m = int(parts[cls]), int(same[cls])
        part = ((own >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        salt = (np.uint64(cls) << np.uint64(40)) + part[starts].astype(np.uint64)
        found = mix(np.add.reduceat(spread, starts) ^ mix(salt + np.uint64(1)))
        empty = k - len(starts)
        if empty >= m:  # common parts may all be empty ones
            bare = np.setdiff1d(np.arange(k), part[starts]).astype(np.uint64)
            found = np.concatenate([found, mix((np.uint64(cls) << np.uint64(40)) + bare + (np.uint64(1) << np.uint64(63)))])
        yield found, cls << 16 | max(0, m - 1 - empty)


def by_bucket(key: np.ndarray, columns: list[np.ndarray], n: int) -> pa.RecordBatch:
    """Rows (bucket, packed columns): parallel arrays dealt out by ``key`` modulo ``n``."""
    bucket = (key % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, start = np.unique(bucket[order], return_index=True)
    ends = [*start[1:].tolist(), len(order)]
    columns = [v[order] for v in columns]
    packed = [pa.array([c[a:b].tobytes() for a, b in zip(start.tolist(), ends, strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *packed], names=["bucket", *[f"c{k}" for k in range(len(columns))]])


def list_entries(docs: DataFrame, buckets: int, words: int, percent: int) -> DataFrame:
    """Entries of all inverted lists of parts, packed by bucket: digests, doc_ids, tags. Sets that a task has met before are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        sigs, ids, tags, n = [], [], [], 0

        def give() -> pa.RecordBatch:
            sig, doc, tag = (np.concatenate(x) for x in (sigs, ids, tags))
            return by_bucket(sig, [sig, doc, tag], buckets)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
                own = shingle_set(text, words)
                key = xxhash.xxh3_64_digest(own.tobytes() + own[:8].tobytes())
                if not len(own) or key in met:
                    continue
                if len(met) < 1_000_000:
                    met.add(key)
                for found, tag in signatures(own, percent):
                    sigs.append(found)
                    ids.append(np.full(len(found), doc_id, np.int64))
                    tags.append(np.full(len(found), tag, np.uint32))
                    n += len(found)
                if n >= GATHERED:
                    yield give()
                    sigs, ids, tags, n = [], [], [], 0
        if n:
            yield give()

    return docs.mapInArrow(run, "bucket long, c0 binary, c1 binary, c2 binary")


class Lists:
    """The inverted lists of one bucket, with the memory of one bounded."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        self.hot = np.zeros(0, np.uint64)

    def add(self, sig: np.ndarray, doc: np.ndarray, tag: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        if len(self.hot):
            is_hot = np.isin(sig, self.hot)
            yield from self.passed_on(sig[is_hot], doc[is_hot], tag[is_hot])
            sig, doc, tag = sig[~is_hot], doc[~is_hot], tag[~is_hot]
        self.parts.append((sig, doc, tag))
        self.held += len(sig)
        if self.held > MOST_HELD:
            sig, doc, tag = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            found, counts = np.unique(sig, return_counts=True)
            new = found[counts > HOT]
            self.hot = np.concatenate([self.hot, new])
            is_hot = np.isin(sig, new)
            yield from self.passed_on(sig[is_hot], doc[is_hot], tag[is_hot])
            self.parts = [(sig[~is_hot], doc[~is_hot], tag[~is_hot])]
            self.held = -len(self.parts[0][0])  # look again after as many more

    @staticmethod
    def passed_on(sig, doc, tag) -> Iterator[tuple[np.ndarray, ...]]:
        if len(sig):
            yield sig, doc, tag, np.full(len(sig), HOT_LENGTH, np.int32)

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Entries of lists with two or more, with their lengths."""
        if not self.parts:
            return
        sig, doc, tag = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        order = np.argsort(sig, kind="stable")
        starts = np.flatnonzero(np.diff(sig[order], prepend=sig[order[:1]] ^ np.uint64(1)))
        counts = np.diff(starts, append=len(order))
        shared = order[np.repeat(counts > 1, counts)]
        if len(shared):
            counts = counts[counts > 1]
            yield sig[shared], doc[shared], tag[shared], np.repeat(counts, counts).astype(np.int32)


def shared_entries(entries: DataFrame, buckets: int) -> DataFrame:
    """Entries of lists with two or more, packed by bucket of documents: digests, doc_ids, tags, lengths."""

    def packed(sig, doc, tag, length) -> pa.RecordBatch:
        return by_bucket(mix(doc.astype(np.uint64)), [sig, doc, tag, length], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, Lists()
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, *raw = (c[k].as_py() for c in batch.columns)
                if bucket != now:
                    yield from (packed(*x) for x in lists.rest())
                    now, lists = bucket, Lists()
                columns = [np.frombuffer(r, t) for r, t in zip(raw, (np.uint64, np.int64, np.uint32), strict=True)]
                yield from (packed(*x) for x in lists.add(*columns))
        yield from (packed(*x) for x in lists.rest())

    return entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, c0 binary, c1 binary, c2 binary, c3 binary")


def without_longest(sig: np.ndarray, doc: np.ndarray, tag: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the entries that are left when each (document, class) leaves out its longest lists."""
    order = np.lexsort((sig, length, tag, doc))
    sig, doc, tag = sig[order], doc[order], tag[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(starts, append=len(order))
    rank = np.arange(len(order)) - np.repeat(starts, sizes)
    return order[rank < np.repeat(sizes - (tag[starts] & 0xFFFF).astype(np.int64), sizes)]


def kept_entries(shared: DataFrame, buckets: int) -> DataFrame:
    """Entries without the longest lists of each document and class, packed by bucket of lists again: digests, doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if parts:
                sig, doc, tag, length = (np.concatenate(x) for x in zip(*parts, strict=True))
                some = without_longest(sig, doc, tag, length)
                if len(some):
                    yield by_bucket(sig[some], [sig[some], doc[some]], buckets)

        for batch in batches:
            for k in range(batch.num_rows):
                bucket, *raw = (c[k].as_py() for c in batch.columns)
                if bucket != now:
                    yield from close()
                    now, parts = bucket, []
                parts.append([np.frombuffer(r, t) for r, t in zip(raw, (np.uint64, np.int64, np.uint32, np.int32), strict=True)])
        yield from close()

    return shared.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, c0 binary, c1 binary")


def cell_edges(kept: DataFrame) -> DataFrame:
    """Each member of a kept list with the member of it that came first: edges (a, b). A task holds one document per list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, hubs = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for bucket, sig, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    now, known, hubs = bucket, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                sig, doc = np.frombuffer(sig, np.uint64), np.frombuffer(doc, np.int64)
                found, first, back = np.unique(sig, return_index=True, return_inverse=True)
                hub = doc[first].copy()
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    old = known[at] == found
                    hub[old] = hubs[at[old]]
                    new = ~old
                else:
                    new = np.ones(len(found), bool)
                known, hubs = np.concatenate([known, found[new]]), np.concatenate([hubs, hub[new]])
                order = np.argsort(known, kind="stable")
                known, hubs = known[order], hubs[order]
                pairs = np.unique(np.stack([doc, hub[back]], 1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return kept.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def links(sets: list[np.ndarray], blocks: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that link the classes of some sets; where blocks differ, only pairs of two blocks are looked at.

    DivideSkip, for each set against the smaller ones before it.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    block = np.array([blocks[i] for i in order])
    cross = len(set(blocks)) > 1
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    token = np.unique(flat, return_inverse=True)[1]
    by_token = np.argsort(token, kind="stable")  # inverted lists, each in order of size
    entries = owner[by_token]
    begin = np.searchsorted(token[by_token], np.arange(int(token.max()) + 1 if len(token) else 0))
    place = np.empty(len(flat), np.int64)
    place[by_token] = np.arange(len(flat))
    offset = np.concatenate([[0], np.cumsum(sizes)])
    label = np.arange(len(order))
    out = []
    for q in range(1, len(order)):
        own = slice(offset[q], offset[q + 1])
        n = int(sizes[q])
        smallest = int(np.searchsorted(sizes[:q], -(-percent * n // 100)))
        if not n or smallest == q:
            continue
        low, high = begin[token[own]], place[own]  # the list up to this set
        length = high - low
        least = int(needed(int(sizes[smallest]), n, percent))
        n_long = min(least - 1, int(least / (0.01 * np.log2(max(2, int(length.max()))) + 1)))
        rank = np.argsort(length, kind="stable")
        short, long = rank[: n - n_long], rank[n - n_long :]
        some = short[length[short] > 0]
        if not len(some):
            continue
        merged = np.concatenate([entries[a:b] for a, b in zip(low[some].tolist(), high[some].tolist(), strict=True)])
        count = np.bincount(merged, minlength=q)
        need = needed(sizes[:q], n, percent)
        live = np.flatnonzero(count >= np.maximum(need - n_long, 1))
        live = live[(live >= smallest) & (label[live] != label[q])]
        if cross:
            live = live[block[live] != block[q]]
        hits = count[live]
        long = long[::-1] if len(live) > len(long) else long
        if len(live) <= len(long):  # fewer sets than long lists: probe the sets for the tokens
            wanted = np.sort(token[own][long])
            tokens = [token[offset[c] : offset[c + 1]] for c in live.tolist()]
            for k, t in enumerate(tokens):
                at = np.minimum(np.searchsorted(t, wanted), len(t) - 1)
                hits[k] += int((t[at] == wanted).sum())
        else:
            for done, j in enumerate(long.tolist()):
                one = entries[low[j] : high[j]]
                if len(one):
                    at = np.minimum(np.searchsorted(one, live), len(one) - 1)
                    hits = hits + (one[at] == live)
                possible = hits + (len(long) - done - 1) >= need[live]
                if not possible.all():
                    live, hits = live[possible], hits[possible]
                    if not len(live):
                        break
        for c in live[hits >= need[live]].tolist():
            if label[c] != label[q]:
                out.append((order[c], order[q]))
                label[label == label[c]] = label[q]
    return out


def cell_links(cells: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of all cells: rows (cell, i, j, block, doc_id, text), a group of (cell, i, j) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, blocks = None, [], [], []

        def close() -> tuple[list, list]:
            if len(sets) < 2:
                return [], []
            found = links(sets, blocks if now[1] != now[2] else [0] * len(sets), percent)
            return [ids[a] for a, _ in found], [ids[b] for _, b in found]

        for batch in batches:
            a, b = [], []
            for start, stop in text_slices(batch.column(5), SLICE):
                part = batch.slice(start, stop - start)
                for cell, i, j, block, doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (cell, i, j) != now:
                        x, y = close()
                        a, b = a + x, b + y
                        now, ids, sets, blocks = (cell, i, j), [], [], []
                    ids.append(doc_id)
                    sets.append(shingle_set(text, words))
                    blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    NULL texts and texts without words have no shingles and link with nothing. Rows with the
    same doc_id are one document. Rows whose doc_id is NULL link with nothing and have no component.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    named = texts.where("doc_id IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(1), SLICE):
                part = batch.slice(start, stop - start)
                sets = [shingle_set(x, words) for x in part.column(1).to_pylist()]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n", "set_key"])

    members = staged(texts.mapInArrow(count, "doc_id long, n long, set_key binary"), "sets")
    first = members.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    same = staged(members.join(first, "set_key", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "sets")
    reps = same.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "rep").distinct()

    buckets = max(8, members.count() // BUCKET_DOCUMENTS)
    shared = staged(shared_entries(list_entries(named, buckets, words, percent), buckets), "lists")
    # few buckets: a pair of documents with many common lists comes once from each
    edges = cell_edges(kept_entries(shared, max(8, buckets // 4)))
    for side in ("a", "b"):
        edges = edges.join(reps.select(F.col("doc_id").alias(side), F.col("rep").alias(f"r{side}")), side).drop(side)
    cells = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b"), "cells")

    sizes = same.where("doc_id = rep").groupBy("rep").agg(F.max("n").alias("n"))
    sized = cells.join(sizes, F.col("node") == F.col("rep")).select("node", F.col("component").alias("cell"), "n")
    grid = sized.groupBy("cell").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"), F.count(F.lit(1)).alias("members")).where("members > 1")
    dealt = sized.join(grid, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    dealt = dealt.select("cell", "node", "block", "blocks", other.alias("other"))
    dealt = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")
    whole = named.join(dealt.hint("shuffle_hash"), F.col("doc_id") == F.col("node")).select("cell", "i", "j", "block", "doc_id", "text")
    found = cell_links(whole.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "doc_id"), words, percent)

    classes = components(found, "classes").withColumnRenamed("node", "rep")
    out = same.join(classes, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose doc_id is the smallest of their class, with the columns they came with; rows without a doc_id stay."""
    dropped = similar(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(dropped.hint("shuffle_hash"), F.col("doc_id") == F.col("__gone"), "left_anti")


def contract(docs: DataFrame) -> DataFrame:
    """Four words, 85 percent: doc_id, n_shingles, component_id."""
    return similar(docs, 4, 85)
