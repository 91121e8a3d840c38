"""Token ids as Arrow files of equal-length sequences.

A file holds record batches with two fixed-size-list columns: ``ids`` and ``mask``
(true where a sequence has an id, false where its end is filled up). Readers map the
file into memory and take any sequence by its number without copying. Beside it lies
a second Arrow file with the place of each document in the stream of ids.

Documents are dealt to files by ranges of ``doc_id`` and sorted inside, so the files in
order hold the ids of all documents in order; only the last sequence of a file is
filled up. A file is written under a passing name and then renamed, so a repeated task
leaves the same file.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.bpe import byte_alphabet
from assayer.llm.common import folder, staged, text_slices
from assayer.llm.merges import MergeTable

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE = 2048
BATCH = 64
#: Bytes of text encoded at once.
ENCODED_BYTES = 1 << 20
#: Words of each of two generations that one worker remembers, and those encoded in one go.
CACHE_ENTRIES = 120_000
JOINED = 20_000


class WordEncoder:
    """Encodes texts as the tokenizers library does, each distinct word once.

    The tokenizer lower-cases, cuts a text into words by a pattern and encodes every word
    by itself, the last token of a word carrying the mark ``</w>``. Texts with characters beyond
    Latin-1, or with the strings of added tokens, are encoded whole by the library.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.table = MergeTable(path)
        stands = {b: c for c, b in byte_alphabet().items()}
        self.symbols = np.array([vocab[stands[b]] for b in range(256)], np.int32)
        self.last_symbols = np.array([vocab[stands[b] + "</w>"] for b in range(256)], np.int32)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters, numbers = ("".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
        space = "\t-\r \x85\xa0"
        self.word = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of ``dtype``."""
        words: list[list[str] | None] = [None] * len(texts)
        whole = []
        for k, text in enumerate(texts):
            if self._plain(text):
                words[k] = self.word.findall(text.lower())
            else:
                whole.append(k)
        missing = set(chain.from_iterable(w for w in words if w)).difference(self.cache)
        if missing and len(self.cache) + len(missing) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
            missing = set(chain.from_iterable(w for w in words if w))
        if known := missing & self.older.keys():
            self.cache.update((x, self.older[x]) for x in known)
            missing -= known
        self._learn(list(missing))
        get = self.cache.__getitem__
        out = [b"".join(map(get, w)) if w else b"" for w in words]
        for k, e in zip(whole, self.library.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, self.dtype).tobytes()
        return out

    def _plain(self, text: str) -> bool:
        """Latin-1 alone, where normal form C is the text itself and lower case goes character by character."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(a in text for a in self.added)

    def _learn(self, words: list[str]) -> None:
        """Encode unknown words, many at once; very long ones go to the library."""
        for some in (words[k : k + JOINED] for k in range(0, len(words), JOINED)):
            raw = [w.encode() for w in some]
            sizes = np.array([len(r) for r in raw])
            flat = self.symbols[np.frombuffer(b"".join(raw), np.uint8)]
            last = np.cumsum(sizes) - 1
            flat[last] = self.last_symbols[np.array([r[-1] for r in raw], np.uint8)]
            for w, ids in zip(some, self.table.encode(flat, sizes), strict=True):
                if ids is None:
                    ids = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
                self.cache[w] = np.frombuffer(ids, "<u4").astype(self.dtype).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class SequenceWriter:
    """Writes a stream of ids as one file of sequences and one file of document places."""

    def __init__(self, where: str, dtype: np.dtype, sequence: int = SEQUENCE):
        self.store, self.path = fs.FileSystem.from_uri(where)
        self.store.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.passing = f"{self.path}.{uuid.uuid4().hex}"
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.places = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sequence, self.dtype, self.rest, self.written = sequence, dtype, np.zeros(0, dtype), 0
        self.docs: list[tuple] = []
        self.n_docs = 0
        self.sinks = [self.store.open_output_stream(self.passing), self.store.open_output_stream(f"{self.passing}.docs")]
        self.out, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], self.places)

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        at = self.written + len(self.rest)
        for doc_id, one in zip(doc_ids, ids, strict=True):
            self.docs.append((doc_id, at, len(one)))
            at += len(one)
        self.rest = np.concatenate([self.rest, *ids])
        step = self.sequence * BATCH
        full = len(self.rest) // step * step
        for k in range(0, full, step):
            self._write(self.rest[k : k + step], step)
        self.written += full
        self.rest = self.rest[full:].copy()
        if len(self.docs) >= 10_000:
            self._write_docs()

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def _write_docs(self) -> None:
        columns = zip(*self.docs, strict=True) if self.docs else ([], [], [])
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=self.places))
        self.n_docs += len(self.docs)
        self.docs = []

    def close(self) -> tuple[int, int]:
        """Documents and ids of the file."""
        real = len(self.rest)
        if real:
            filled = np.zeros(-(-real // self.sequence) * self.sequence, self.dtype)
            filled[:real] = self.rest
            self._write(filled, real)
        self._write_docs()
        for x in (self.out, self.index, *self.sinks):
            x.close()
        self.store.move(f"{self.passing}.docs", f"{self.path}.docs")
        self.store.move(self.passing, self.path)
        return self.n_docs, self.written + real


class SequenceFile:
    """Random access to a written file; local files are mapped into memory and not copied."""

    def __init__(self, where: str):
        store, path = fs.FileSystem.from_uri(where)
        opened = [pa.memory_map(p) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(p) for p in (path, f"{path}.docs")]
        self.file, self.docs = (pa.ipc.open_file(x) for x in opened)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.at, self.flat = -1, np.zeros(0, np.uint16)

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids of batch ``k`` as one array without a copy, and its mask."""
        got = self.file.get_batch(k)
        return got.column(0).values.to_numpy(zero_copy_only=True), got.column(1).values

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop`` of the file's stream."""
        step, parts = self.sequence * BATCH, []
        for k in range(start // step, -(-stop // step)):
            if k != self.at:
                self.at, (self.flat, _) = k, self.batch(k)
            parts.append(self.flat[max(start - k * step, 0) : stop - k * step])
        return np.concatenate(parts) if parts else self.flat[:0]

    def places(self) -> Iterator[pa.RecordBatch]:
        return (self.docs.get_batch(k) for k in range(self.docs.num_record_batches))


def write(docs: DataFrame, path: str, where: str, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """Write all documents (doc_id, text) below ``where``; one row per file: part, path, n_docs, n_tokens.

    ``end_id`` follows each document. NULL and empty texts give the end id alone; a NULL
    doc_id comes first; rows with the same doc_id follow each other by text. An empty table
    gives no file. The rows are a written table, so files are written once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, by, out = TaskContext.get().partitionId(), encoder(path), None
        name = f"{where}/part-{part:06d}.arrow"
        for batch in batches:
            for start, stop in text_slices(batch.column(1), ENCODED_BYTES):
                some = batch.slice(start, stop - start)
                out = out or SequenceWriter(name, by.dtype, sequence)
                end = np.array([end_id], by.dtype)
                ids = by.encode_many([x or "" for x in some.column(1).to_pylist()])
                out.add(some.column(0).to_pylist(), [np.concatenate([np.frombuffer(x, by.dtype), end]) for x in ids])
        if out:
            n_docs, n_tokens = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(rows.mapInArrow(run, "part long, path string, n_docs long, n_tokens long"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    One file is one task, read batch by batch. Only the list of files meets in one window.
    """
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.select("path", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = SequenceFile(where)
                for places in file.places():
                    starts, sizes = (places.column(k).to_pylist() for k in (1, 2))
                    crc = [zlib.crc32(file.ids(s, s + n).astype("<u4").tobytes()) for s, n in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [places.column(0), pa.array([base + s for s in starts], pa.int64()), places.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    spread = max(1, files.count())
    return listed.repartition(spread, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(spark: SparkSession, docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write all documents to a new shared folder and read them back."""
    where = folder(spark, "tokens")
    return read(write(docs, path, where if "://" in where else f"file://{where}", end_id))
