"""Repeated passages, found through count-min sketches and confirmed exactly.

A window is some words in a row (20). Of all equal windows the first one stays, by (doc_id,
start); every word that any other one covers is removed.

First pass, the sketch. A window is counted under its minimizer: of the half-length
sequences inside it, the one with the least hash, the leftmost of equals. Equal windows have the same minimizer
at the same place, so the count of a minimizer is never less than that of its
windows, while neighbours share one and only every sixth word counts. Every task counts the
minimizers of its texts, which gives partition sketches in sparse form, dealt by class of hash; the
task of a class adds them up to the counters of a count-min sketch and reads the estimates off it.
The number of classes follows the text, so the sketch is as wide as the data need and nobody holds it whole.

Second pass, exactly. Only windows whose minimizer is estimated to be there twice are looked at. A task
keeps the first of equal ones that it meets itself, so that a passage in a third
of all documents leaves it once; the rest goes, packed, to the task of its class, which finds the
first of all by two independent 64-bit hashes of the window. Windows that are not the first travel back to
their documents as runs with the sum of their hashes, and a run counts only where the text
has that sum. Estimates change how much is checked, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.llm.common import staged, text_slices
from assayer.llm.ngram_join import by_bucket, mix
from assayer.llm.wordstream import doc_starts, kept_words, spaced, word_hashes

WINDOW = 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Entries that a task gathers before it gives them out, and entries of a class.
GATHERED = 1 << 20
CLASS_ENTRIES = 1_000_000
LEAST_CLASSES = 64
#: Rows of the sketch, and counters of a row for each entry that is expected in a class.
DEPTH = 2
SPARE = 4
#: Bytes of text for each minimizer, at a guess from below.
BYTES = 24


class Windows:
    """Windows and minimizers of the words of several documents."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, window: int):
        half = window // 2
        n = max(0, len(words) - window + 1)
        self.doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.valid = self.doc[:n] == self.doc[window - 1 :][:n]
        grams = np.zeros(max(0, len(words) - half + 1), np.uint64)
        for k in range(half):
            grams = grams * BASE + words[k : len(grams) + k]
        rest = window - half
        shift = np.uint64(pow(int(BASE), rest, 1 << 64))
        tail = grams if rest == half else grams[: max(0, len(words) - rest + 1)] * BASE + words[half : max(half, len(words))][: max(0, len(words) - rest + 1)]
        #: Hash of each window, and of each sequence of half the length.
        self.whole = mix(grams[:n] * shift + tail[half : half + n] + BASE)
        self.part = mix(grams)
        least, at = self.part[:n].copy(), np.zeros(n, np.int64)
        for k in range(1, rest + 1):
            other = self.part[k : n + k]
            less = other < least
            np.copyto(least, other, where=less)
            at[less] = k
        #: Place of each window's minimizer.
        self.minimizer = np.arange(n) + at


def scanned(batch: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, Windows, pa.RecordBatch]]:
    """Document ids, starts, windows and rows of each slice of a batch (doc_id, text, ...)."""
    for start, stop in text_slices(batch.column(1)):
        part = batch.slice(start, stop - start)
        hashed = [word_hashes(t) for t in part.column(1).to_pylist()]
        starts = doc_starts([len(h) for h in hashed])
        yield np.asarray(part.column(0)), starts, Windows(np.concatenate(hashed), starts, window), part


def classes_of(n: int) -> int:
    return max(LEAST_CLASSES, -(-n // CLASS_ENTRIES))


def read(raw: list[bytes], *kinds) -> list[np.ndarray]:
    return [np.frombuffer(r or b"", k) for r, k in zip(raw, kinds, strict=True)]


def grouped(rows: DataFrame, work, schema: str) -> DataFrame:
    """Rows (bucket, packed columns) dealt by bucket; ``work`` gets the raw columns of one bucket at a time and gives batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield from work(held)
                    held = []
                now = bucket
                held.append(raw)
        if held:
            yield from work(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def placed(rows: pa.RecordBatch, columns: list[int], n: int) -> pa.RecordBatch:
    """Packed rows (bucket, ...) with their columns put at some of ``n`` places, the others NULL."""
    none = pa.array([None] * len(rows), pa.binary())
    at = dict(zip(columns, rows.columns[1:], strict=True))
    return pa.RecordBatch.from_arrays([rows.column(0), *[at.get(k, none) for k in range(n)]], names=["bucket", *[f"c{k}" for k in range(n)]])


def partition_sketches(docs: DataFrame, window: int, classes: int) -> DataFrame:
    """Minimizers counted by task, packed by class: once seen (hash, document, place), twice seen (hash); and the places of the latter."""

    def packed(hashes: list, docs: list, places: list) -> Iterator[pa.RecordBatch]:
        hashed, doc, place = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
        order = np.argsort(hashed)
        hashed, doc, place = hashed[order], doc[order], place[order]
        new = np.ones(len(hashed), bool)
        new[1:] = hashed[1:] != hashed[:-1]
        first = np.flatnonzero(new)
        counts = np.diff(first, append=len(hashed))
        once, twice = first[counts == 1], first[counts > 1]
        if len(once):
            columns = [hashed[once].astype(np.uint32), doc[once], place[once].astype(np.int32)]
            yield placed(by_bucket(hashed[once] >> np.uint64(32), columns, classes), [0, 1, 2], 4)
        if len(twice):
            yield placed(by_bucket(hashed[twice] >> np.uint64(32), [hashed[twice].astype(np.uint32)], classes), [3], 4)
            again = np.repeat(counts > 1, counts)
            yield placed(by_bucket(mix(doc[again].astype(np.uint64)), [doc[again], place[again].astype(np.int32)], classes), [1, 2], 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, places, n = [], [], [], 0
        for batch in batches:
            for ids, starts, w, _ in scanned(batch, window):
                at = w.minimizer[w.valid]
                at = at[np.diff(at, prepend=-1) > 0]
                hashes.append(mix(w.part[at] + BASE))
                docs.append(ids[w.doc[at]])
                places.append(at - starts[w.doc[at]])
                n += len(at)
                if n >= GATHERED:
                    yield from packed(hashes, docs, places)
                    hashes, docs, places, n = [], [], [], 0
        if n:
            yield from packed(hashes, docs, places)

    return docs.mapInArrow(run, "bucket long, c0 binary, c1 binary, c2 binary, c3 binary")


class CountMin:
    """Counters of 32-bit hashes; an estimate is never below the true count."""

    def __init__(self, width: int):
        self.bits = max(10, int(width - 1).bit_length())
        self.counts = np.zeros((DEPTH, 1 << self.bits), np.int32)

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        turned = (hashes * np.uint32(2654435761)) >> np.uint32(32 - self.bits)
        return [(hashes & np.uint32((1 << self.bits) - 1)).astype(np.int64), turned.astype(np.int64)]

    def add(self, hashes: np.ndarray, times: int) -> None:
        for row, at in zip(self.counts, self.places(hashes), strict=True):
            np.add.at(row, at, times)

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum(*[row[at] for row, at in zip(self.counts, self.places(hashes), strict=True)])


def suspects(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document with suspected windows: doc_id, n, places (of their minimizers, packed)."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    classes = classes_of(size // BYTES)
    width = SPARE * max(1, min(CLASS_ENTRIES, size // BYTES // classes))

    def estimated(held: list) -> Iterator[pa.RecordBatch]:
        sketch = CountMin(width)
        parts = [read(raw, np.uint32, np.int64, np.int32, np.uint32) for raw in held]
        for once, _, _, twice in parts:
            sketch.add(once, 1)
            sketch.add(twice, 2)
        found = []
        for once, doc, place, _ in parts:
            # places that come without hashes were seen twice by their own task
            some = sketch.estimate(once) > 1 if len(once) else np.ones(len(doc), bool)
            found.append((doc[some], place[some]))
        doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(doc):
            yield by_bucket(mix(doc.astype(np.uint64)), [doc, place], classes)

    def by_document(held: list) -> Iterator[pa.RecordBatch]:
        doc, place = (np.concatenate(x) for x in zip(*[read(raw, np.int64, np.int32) for raw in held], strict=True))
        yield from per_document(doc, [place])

    sketched = grouped(partition_sketches(docs, window, classes), estimated, "bucket long, c0 binary, c1 binary")
    return staged(grouped(sketched, by_document, "doc_id long, n long, c0 binary").withColumnRenamed("c0", "places"), "suspects")


def per_document(doc: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, packed columns), one per document."""
    order = np.argsort(doc, kind="stable")
    names, start = np.unique(doc[order], return_index=True)
    bounds = list(zip(start.tolist(), [*start[1:].tolist(), len(order)], strict=True))
    packed = [pa.array([c[a:b].tobytes() for a, b in bounds], pa.binary()) for c in (c[order] for c in columns)]
    sizes = pa.array([b - a for a, b in bounds], pa.int64())
    if len(names):
        yield pa.RecordBatch.from_arrays([pa.array(names), sizes, *packed], names=["doc_id", "n", *[f"c{k}" for k in range(len(columns))]])


def later_ones(part: np.ndarray, whole: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of windows: those first by (document, start) among equal ones, and those after."""
    order = np.argsort(whole)
    same = whole[order[1:]] == whole[order[:-1]]
    if (same & (part[order[1:]] != part[order[:-1]])).any():
        order = np.lexsort((part, whole))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order[1:]] != whole[order[:-1]]) | (part[order[1:]] != part[order[:-1]])
    groups = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    doc, start = doc[order], start[order]
    ahead = doc == np.minimum.reduceat(doc, groups)[group]
    least = np.minimum.reduceat(np.where(ahead, start, np.iinfo(start.dtype).max), groups)[group]
    ahead &= start == least
    first, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    picked = np.flatnonzero(ahead)
    first[order[picked[np.diff(group[picked], prepend=-1) > 0]]] = True  # rows that share a doc_id may hold it twice
    later[order[~ahead]] = True
    return first, later


def runs_of(doc: np.ndarray, text: np.ndarray, start: np.ndarray, whole: np.ndarray) -> list[np.ndarray]:
    """Consecutive windows of a text put together: documents, starts, numbers of windows, sums of their hashes."""
    order = np.lexsort((start, text, doc))
    doc, text, start, whole = doc[order], text[order], start[order], whole[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return [doc[first], start[first].astype(np.int32), np.diff(first, append=len(doc)).astype(np.int32), np.add.reduceat(whole, first) if len(first) else whole[:0]]


def candidates(suspected: DataFrame, window: int, classes: int) -> DataFrame:
    """Windows with a suspected minimizer (doc_id, text, places), packed by class.

    One of equal windows of a task is a candidate: groups of windows with a common minimizer as (its hash,
    document, mark of the text, first start, number), and the hashes of the windows; the others are runs to be
    removed. The mark keeps apart texts that share a doc_id.
    """

    def packed(columns: list) -> Iterator[pa.RecordBatch]:
        part, whole, doc, text, start = (np.concatenate(c) for c in zip(*columns, strict=True))
        first, later = later_ones(part, whole, doc, start)
        names = ["bucket", *[f"c{k}" for k in range(6)]]
        at = np.flatnonzero(first)  # in order of the documents' windows
        new = np.ones(len(at), bool)
        new[1:] = (doc[at[1:]] != doc[at[:-1]]) | (start[at[1:]] != start[at[:-1]] + 1) | (part[at[1:]] != part[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
        head = np.flatnonzero(new)
        size = np.diff(head, append=len(at))
        cls = (mix(part[at[head]]) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        found, begin = np.unique(cls[order], return_index=True)
        ends = [*begin[1:].tolist(), len(order)]
        inside = np.argsort(np.repeat(cls, size), kind="stable")
        hashes, cut = whole[at][inside], np.concatenate([[0], np.cumsum(size[order])])
        own = [part[at[head]][order], doc[at[head]][order], text[at[head]][order], start[at[head]][order].astype(np.int32), size[order].astype(np.int32)]
        rows = [[*[c[a:b].tobytes() for c in own], hashes[cut[a] : cut[b]].tobytes()] for a, b in zip(begin.tolist(), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(found), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(6)]], names=names)
        if later.any():
            gone = runs_of(doc[later], text[later], start[later], whole[later])
            yield placed(by_bucket(mix(gone[0].astype(np.uint64)), gone, classes), [1, 2, 3, 4], 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for ids, starts, w, rows in scanned(batch, window):
                marks = np.array([xxhash.xxh32_intdigest(t or "") for t in rows.column(1).to_pylist()], np.uint32)
                flagged = np.zeros(len(w.doc) + 1, bool)
                for k, raw in enumerate(rows.column(2).to_pylist()):
                    places = np.frombuffer(raw, np.int32)
                    flagged[starts[k] + places[places < starts[k + 1] - starts[k]]] = True
                at = np.flatnonzero(w.valid & flagged[w.minimizer])
                doc = w.doc[at]
                held.append((w.part[w.minimizer[at]], w.whole[at], ids[doc], marks[doc], at - starts[doc]))
                n += len(at)
                if n >= GATHERED:
                    yield from packed(held)
                    held, n = [], 0
        if n:
            yield from packed(held)

    return suspected.mapInArrow(run, "bucket long, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, c5 binary")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document that loses words: doc_id, n, and runs of windows that are not the first of their kind: starts, windows, sums (packed)."""
    found = suspects(docs, window)
    total = found.agg(F.sum("n")).first()[0] or 0
    classes = classes_of(total * window // 4)

    def judged(held: list) -> Iterator[pa.RecordBatch]:
        columns, gone = [], []
        for raw in held:
            if raw[0] is None:
                gone.append(read(raw[1:5], np.int64, np.int32, np.int32, np.uint64))
                continue
            part, doc, text, start, size, whole = read(raw, np.uint64, np.int64, np.uint32, np.int32, np.int32, np.uint64)
            inside = np.arange(len(whole)) - np.repeat(np.cumsum(size) - size, size)
            columns.append((np.repeat(part, size), whole, np.repeat(doc, size), np.repeat(text, size), np.repeat(start, size) + inside))
        if columns:
            part, whole, doc, text, start = (np.concatenate(c) for c in zip(*columns, strict=True))
            _, later = later_ones(part, whole, doc, start)
            gone.append(runs_of(doc[later], text[later], start[later], whole[later]))
        doc, start, size, total = (np.concatenate(c) for c in zip(*gone, strict=True))
        if len(doc):
            yield by_bucket(mix(doc.astype(np.uint64)), [doc, start, size, total], classes)

    def by_document(held: list) -> Iterator[pa.RecordBatch]:
        doc, *rest = (np.concatenate(c) for c in zip(*[read(raw, np.int64, np.int32, np.int32, np.uint64) for raw in held], strict=True))
        yield from per_document(doc, rest)

    suspected = docs.join(found.select("doc_id", "places").hint("shuffle_hash"), "doc_id").select("doc_id", "text", "places")
    rows = grouped(candidates(suspected, window, classes), judged, "bucket long, c0 binary, c1 binary, c2 binary, c3 binary")
    return staged(grouped(rows, by_document, "doc_id long, n long, c0 binary, c1 binary, c2 binary"), "repeats")


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows with their text without repeated passages, ``ss_words`` (words before) and ``ss_removed``.

    A text that loses words is its other words, joined by single spaces; any other text stays as it is. NULL
    and empty texts, and texts of fewer words than a window, lose nothing. Places are told apart by
    (doc_id, start): rows that share a doc_id don't repeat each other at the same start, so repeated rows keep
    or lose the same words; texts that differ may share a doc_id, each is judged by itself. Rows whose doc_id is NULL are neither counted nor changed. Windows are judged on the
    input, equal windows inside one text too. Input columns named like the new ones are replaced.
    """
    rows = docs.drop("ss_words", "ss_removed")
    names = rows.columns
    place, width = names.index("text"), len(names)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("ss_words long, ss_removed long").fields])
    gone = repeats(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text"), window)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(place)):
                part = batch.slice(start, stop - start)
                texts, sizes, removed = part.column(place).to_pylist(), [], []
                for k, raw in enumerate(zip(*(c.to_pylist() for c in part.columns[width:]), strict=True)):
                    if raw[0] is None:
                        sizes.append(len((texts[k] or "").encode().split()))
                        removed.append(0)
                        continue
                    words = word_hashes(texts[k])
                    covered = lost_words(words, raw, window)
                    sizes.append(len(words))
                    removed.append(int(covered.sum()))
                    if removed[-1]:
                        texts[k] = kept_words(texts[k], ~covered)
                columns = list(part.columns[:width])
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    lost = gone.select(F.col("doc_id").alias("__ss_id"), *[F.col(f"c{k}").alias(f"__ss{k}") for k in range(3)])
    joined = rows.join(lost.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__ss_id"), "left")
    return joined.select(*[rows[f"`{c}`"] for c in names], *[lost[f"__ss{k}"] for k in range(3)]).mapInArrow(rewrite, schema)


def lost_words(words: np.ndarray, raw: tuple[bytes, ...], window: int) -> np.ndarray:
    """Flags of the words that runs of windows cover; a run counts where the windows of the text have its sum."""
    start, size, total = read(list(raw), np.int32, np.int32, np.uint64)
    whole = Windows(words, doc_starts([len(words)]), window).whole
    real = start.astype(np.int64) + size <= len(whole)
    start, size, total = start[real].astype(np.int64), size[real].astype(np.int64), total[real]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(whole, dtype=np.uint64)])
    own = sums[start + size] - sums[start] == total
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start[own], 1)
    np.add.at(edge, start[own] + size[own] - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def contract(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    out = dedup_substrings(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("ss_words").alias("n_words"), F.col("ss_removed").alias("n_removed"), F.sha2(spaced(F.col("text")), 256).alias("kept_sha256"))
