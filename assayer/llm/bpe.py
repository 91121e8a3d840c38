"""Byte-pair encoding by forced boundaries, and decoding.

A byte pair that never stands inside any token of the vocabulary can never be merged
across, so a place with such a pair is a certain cut: the two sides may be encoded on
their own and their ids concatenated. A text is first cut where the tokenizer's word
pattern cuts, then every word at its certain cuts; the fragments are merged many at
once, and the ids of a word are its fragments' ids, concatenated. Each distinct word is
worked out once per worker and kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import text_slices
from assayer.llm.merges import MergeTable

#: Words of each of two generations that one worker remembers.
CACHE_ENTRIES = 250_000
#: Words that are merged in one go.
JOINED = 20_000
ENCODED = "tokens binary, n_tokens long"


def byte_alphabet() -> dict[str, int]:
    """Byte-level alphabet: each printable Latin-1 character stands for its own byte, the other bytes for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedSplitter:
    """Encodes texts as the tokenizers library does, fragment by fragment between certain cuts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        alphabet = byte_alphabet()
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        size = max([*self.library.get_vocab().values()], default=-1) + 1
        self.token_bytes = [b""] * size
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            text = added.get(i, token)
            known = all(c in alphabet for c in text)
            self.token_bytes[i] = bytes(alphabet[c] for c in text) if known else text.encode()
        #: inside[a, b]: some token holds byte a followed by byte b.
        self.inside = np.zeros((256, 256), bool)
        for token in self.token_bytes:
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.table = MergeTable(path)
        self.symbols = np.zeros(256, np.int32)
        self.symbols[list(alphabet.values())] = [self.table.vocab[c] for c in alphabet]
        self.alphabet = alphabet
        texts = [re.escape(t) for t in sorted(added.values(), key=len, reverse=True)]
        self.added = re.compile(f"({'|'.join(texts)})") if texts else None
        letters, numbers = ("".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
        space = "\t-\r \x85\xa0"
        self.word = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
        )
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.added_ids = {t: np.array([i], "<u4").tobytes() for i, t in added.items()}

    def words(self, text: str) -> list[str]:
        """The text cut by the word pattern and around added tokens; joined they give the text again."""
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:  # the library knows all classes of characters
            get = self.alphabet.__getitem__
            return [bytes(map(get, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.word.findall(text)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.words(t) for t in texts]
        missing = set(chain.from_iterable(cut)).difference(self.cache)
        if missing and len(self.cache) + len(missing) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
            missing = set(chain.from_iterable(cut))
        if known := missing & self.older.keys():
            self.cache.update((x, self.older[x]) for x in known)
            missing -= known
        if added := missing & self.added_ids.keys():
            self.cache.update((x, self.added_ids[x]) for x in added)
            missing -= added
        self._learn(list(missing))
        get = self.cache.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def fragments(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where fragments start in words given as one run of bytes: at each word and each certain cut."""
        starts = np.zeros(len(raw), bool)
        starts[1:] = ~self.inside[raw[:-1], raw[1:]]
        starts[np.cumsum(sizes) - sizes] = True
        return np.flatnonzero(starts)

    def _learn(self, words: list[str]) -> None:
        """Encode unknown words: cut them to fragments, merge all fragments at once, concatenate."""
        for some in (words[k : k + JOINED] for k in range(0, len(words), JOINED)):
            encoded = [w.encode() for w in some]
            sizes = np.array([len(w) for w in encoded])
            raw = np.frombuffer(b"".join(encoded), np.uint8)
            starts = self.fragments(raw, sizes)
            flat = self.symbols[raw]
            lengths = np.diff(starts, append=len(raw))
            ids = self.table.encode(flat, lengths)
            for k in (k for k, x in enumerate(ids) if x is None):
                merged = self.table.merge(flat[None, starts[k] : starts[k] + lengths[k]].copy())[0]
                ids[k] = merged[merged >= 0].astype("<u4").tobytes()
            at = [*np.searchsorted(starts, np.cumsum(sizes) - sizes).tolist(), len(starts)]
            self.cache.update((w, ids[at[k]] if at[k + 1] == at[k] + 1 else b"".join(ids[at[k] : at[k + 1]])) for k, w in enumerate(some))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 turn into U+FFFD, unknown ids into nothing."""
        table = self.token_bytes
        try:
            return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        except IndexError:
            return b"".join(table[i] for i in np.frombuffer(ids, "<u4").tolist() if i < len(table)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def splitter(path: str) -> ForcedSplitter:
    """One splitter per worker and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ForcedSplitter(path)


def utf8(value: str | None) -> str:
    return value or ""


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append ``tokens`` (ids, little-endian unsigned 32-bit) and ``n_tokens`` to every row.

    NULL and empty texts have no ids. Columns of the input that are named like the two
    new ones are replaced. No row moves: there is no shuffle.
    """
    docs = docs.drop("tokens", "n_tokens")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), ENCODED])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = splitter(path)
        for batch in batches:
            for start, stop in text_slices(batch.column(place)):
                part = batch.slice(start, stop - start)
                ids = by.encode_many([utf8(x) for x in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[*part.schema.names, "tokens", "n_tokens"]
                )

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Append ``decoded``, the text that the ids in ``tokens`` give; NULL ids give an empty text."""
    encoded = encoded.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded string"])
    place = encoded.columns.index("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = splitter(path)
        for batch in batches:
            for start, stop in text_slices(batch.column(place)):
                part = batch.slice(start, stop - start)
                texts = [by.decode(x or b"") for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode, and digest both: the input's rows with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Ids go through one pass: what :func:`encode` gives is decoded in the same task and only digests leave it.
    """
    keep = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema), "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    place = keep.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = splitter(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for start, stop in text_slices(batch.column(place)):
                part = batch.slice(start, stop - start)
                ids = by.encode_many([utf8(x) for x in part.column(place).to_pylist()])
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(by.decode(x).encode()) for x in ids])]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return keep.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs.select("doc_id", F.col("text")), path).drop("text")
