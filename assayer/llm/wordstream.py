"""Words of whole texts as arrays of hashes, and texts with some of their words."""

from __future__ import annotations

from itertools import compress

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.llm.quality import word_parts


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between white space, a bounded part of the text at a time."""
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part)) for part in word_parts(text or "")]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def kept_words(text: str, keep: np.ndarray) -> str:
    """The words whose flag is set, joined by one space."""
    out, at = [], 0
    for part in word_parts(text):
        out += compress(part, keep[at : at + len(part)].tolist())
        at += len(part)
    return b" ".join(out).decode()


def spaced(text: Column) -> Column:
    """All words of a text joined by one space; NULL gives an empty text."""
    return F.btrim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), F.lit("  +"), F.lit(" ")))


def doc_starts(sizes: list[int] | np.ndarray) -> np.ndarray:
    """Where each document begins in the words of all, and the end."""
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
