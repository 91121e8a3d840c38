"""Repeated lines, found with Bloom filters and confirmed exactly.

First pass: every task hashes the keys of its lines (once per document) and sums equal
hashes up; hashes travel packed, by class of hash, and the number of classes follows the
number of lines. The task of a class keeps a Bloom filter of fixed size of the hashes it
has seen, gathers every hash that the filter holds already, and gives each of them out
once. A hash that did repeat is always given out, for no other filter stands behind the
first; a few others may be, which costs only their exact check.

The hashes given out fill a second filter whose size follows their number up to a fixed
bound; that filter alone is broadcast. Second pass: lines whose hash is in it are the
suspected repeats, and only they are shuffled, as (document, SHA-256 of the key): they
are counted exactly and the document that keeps the line is chosen. Third pass: each
document drops its lines. Sizes of filters change how much is checked, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.llm.common import staged, text_slices

MIN_CHARS = 20
MIN_DOCUMENTS = 3
STRIPPED = " \t\n\x0b\x0c\r"
#: Line keys per class of hashes, and bits of a class's filter (one byte each while it is filled): a sixth of them is set at most.
CLASS_KEYS = 1_000_000
CLASS_BITS = 1 << 24
#: Hashes that a task gathers before it gives them out.
GATHERED = 1 << 21
#: Bits of a segment of the broadcast filter, and segments at most (32 MB).
SEGMENT_BITS = 1 << 20
MOST_SEGMENTS = 1 << 8


def line_key(line: str) -> bytes:
    """What makes two lines equal: stripped, A-Z in lower case."""
    return line.strip(STRIPPED).encode().lower()


def long_keys(text: str | None, min_chars: int) -> set[bytes]:
    """Distinct keys of a text that have enough code points."""
    keys = (line.strip(STRIPPED) for line in (text or "").split("\n"))
    return {k.encode().lower() for k in keys if len(k) >= min_chars}


def probes(hashes: np.ndarray, bits: int, n: int = 3) -> np.ndarray:
    """``n`` places of each hash in a filter of ``bits`` (a power of two), from its low 48 bits."""
    step = (hashes >> np.uint64(24)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(n)]).astype(np.int64)


def class_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    """Class of each hash, from its high 32 bits: up to 65,536 classes share none with the places in a filter."""
    return ((hashes >> np.uint64(32)) * np.uint64(classes) >> np.uint64(32)).astype(np.int64)


class SeenTwice:
    """A Bloom filter of hashes seen, and the hashes that came when it held them already."""

    def __init__(self, bits: int = CLASS_BITS):
        self.bits, self.once = bits, np.zeros(bits, bool)
        self.found, self.more, self.n_more = np.zeros(0, np.uint64), [], 0

    def add(self, once: np.ndarray, twice: np.ndarray) -> np.ndarray:
        """Take in distinct hashes, those in ``twice`` seen more than once already; give all that are seen again, also those given before."""
        hashes = np.concatenate([once, twice])
        at = probes(hashes, self.bits)
        again = self.once[at].all(0)
        again[len(once) :] = True
        self.once[at] = True
        out = hashes[again]
        self.more.append(out)
        self.n_more += len(out)
        if self.n_more > max(GATHERED // 8, len(self.found)):
            self.repeated()
        return out

    def repeated(self) -> np.ndarray:
        """All hashes given so far, once each."""
        self.found, self.more, self.n_more = np.unique(np.concatenate([self.found, *self.more])), [], 0
        return self.found


def most_keys(docs: DataFrame, min_chars: int) -> int:
    """Line keys of all documents, at most: lines with enough code points before they are stripped."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) >= min_chars)
    return docs.agg(F.sum(F.size(lines).cast("long"))).first()[0] or 0


def suspects(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hashes of line keys that may stand in two documents or more, packed: rows (n, hashes)."""
    classes = max(8, -(-most_keys(docs, min_chars) // CLASS_KEYS))

    def pack(parts: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
        group = class_of(hashes, classes)
        order = np.argsort(group, kind="stable")
        hashes, counts, group = hashes[order], counts[order], group[order]
        found, start = np.unique(group, return_index=True)
        ends = [*start[1:].tolist(), len(group)]
        rows = [(hashes[a:b][counts[a:b] == 1].tobytes(), hashes[a:b][counts[a:b] > 1].tobytes()) for a, b in zip(start.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))], names=["cls", "once", "twice"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                keys = long_keys(text.as_py(), min_chars)
                parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                n += len(keys)
                if n >= GATHERED:
                    yield pack(parts)
                    parts, n = [], 0
        if n:
            yield pack(parts)

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, None
        give = lambda found: pa.RecordBatch.from_pydict({"n": [len(found)], "hashes": pa.array([found.tobytes()], pa.binary())})
        for batch in batches:
            for cls, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cls != now:
                    if now is not None:
                        yield give(seen.repeated())
                    now, seen = cls, SeenTwice(CLASS_BITS)
                seen.add(np.frombuffer(once, np.uint64), np.frombuffer(twice, np.uint64))
        if now is not None:
            yield give(seen.repeated())

    packed = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(hashed, "cls long, once binary, twice binary")
    return staged(packed.repartition("cls").sortWithinPartitions("cls").mapInArrow(repeated, "n long, hashes binary"), "line-suspects")


def suspect_filter(found: DataFrame) -> np.ndarray:
    """A Bloom filter of all hashes in ``found``: rows of packed bits, one per segment; 32 MB at most."""
    total = found.agg(F.sum("n")).first()[0] or 0
    segments = 1
    while segments < MOST_SEGMENTS and segments * SEGMENT_BITS < 16 * total:
        segments *= 2

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                hashes = np.frombuffer(raw, np.uint64)
                group = hashes >> np.uint64(48) & np.uint64(segments - 1)
                names = np.unique(group)
                yield pa.RecordBatch.from_pydict({"segment": pa.array(names.astype(np.int64)), "hashes": pa.array([hashes[group == s].tobytes() for s in names], pa.binary())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, np.zeros(0, bool)
        give = lambda: pa.RecordBatch.from_pydict({"segment": [now], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})
        for batch in batches:
            for segment, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != now:
                    if now is not None:
                        yield give()
                    now, bits = segment, np.zeros(SEGMENT_BITS, bool)
                bits[probes(np.frombuffer(raw, np.uint64), SEGMENT_BITS)] = True
        if now is not None:
            yield give()

    out = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    parts = found.select("hashes").mapInArrow(split, "segment long, hashes binary").repartition("segment").sortWithinPartitions("segment")
    for row in parts.mapInArrow(fill, "segment long, bits binary").toLocalIterator():
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    segment = (hashes >> np.uint64(48) & np.uint64(len(bits) - 1)).astype(np.int64)
    at = probes(hashes, SEGMENT_BITS)
    return (bits[segment, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(0)


def dropped_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Per document that loses lines: doc_id, keys (SHA-256 of the line keys it loses)."""
    shared = docs.sparkSession.sparkContext.broadcast(suspect_filter(suspects(docs, min_chars)))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                doc_ids, keys = [], []
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = list(long_keys(text, min_chars))
                    hit = in_filter(shared.value, np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)))
                    some = [hashlib.sha256(own[k]).digest() for k in np.flatnonzero(hit).tolist()]
                    doc_ids += [doc_id] * len(some)
                    keys += some
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "key": pa.array(keys, pa.binary())})

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    pairs = staged(rows.mapInArrow(suspected, "doc_id long, key binary"), "line-pairs")
    counts = pairs.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    lost = pairs.join(counts.where(F.col("n") >= min_documents).select("key", "keeper"), "key").where("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All rows with their text without repeated lines, ``ld_lines`` (lines before) and ``ld_dropped``.

    A NULL or empty text is one empty line and stays as it is. Documents are told apart by
    ``doc_id``: rows that share one count once and keep or lose a line alike. Rows whose doc_id
    is NULL are neither counted nor changed. Input columns named like the new ones are replaced.
    """
    rows = docs.drop("ld_lines", "ld_dropped")
    names = rows.columns
    place, width = names.index("text"), len(names)
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("ld_lines long, ld_dropped long").fields])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(place)):
                part = batch.slice(start, stop - start)
                texts, lines, dropped = [], [], []
                for text, keys in zip(part.column(place).to_pylist(), part.column(width).to_pylist(), strict=True):
                    own = (text or "").split("\n")
                    lines.append(len(own))
                    if keys:
                        lost = set(keys)
                        kept = [x for x in own if len(x) < min_chars or hashlib.sha256(line_key(x)).digest() not in lost]
                        text = "\n".join(kept)
                    dropped.append(len(own) - (len(kept) if keys else len(own)))
                    texts.append(text)
                columns = list(part.columns[:width])
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    lost = dropped_keys(docs, min_chars, min_documents).select(F.col("doc_id").alias("__lost_id"), F.col("keys").alias("__lost"))
    joined = rows.join(lost.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("__lost_id"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], "__lost").mapInArrow(rewrite, schema)


def contract(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
