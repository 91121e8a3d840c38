"""Quality by weak supervision.

Rules look at counts of a document and vote to keep it, vote to reject it, or abstain.
Nobody says how good a rule is: expectation-maximisation over the vote patterns of all
documents estimates, for good and for bad documents, how often each rule votes which way,
and from that the posterior probability that a document with these votes is good.

Counts come from one pass over the texts and are written; patterns (at most 3 to the
number of rules) are counted over all documents, and only these counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.llm.common import staged, text_slices

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
#: Bytes split into words at once.
PART_BYTES = 8 << 20
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, qr_lines long, qr_distinct long, qr_upper long, qr_bangs long"


def word_parts(text: str, lower: bool = False) -> Iterator[list[bytes]]:
    """Words between white space, a bounded part at a time; ``lower``: with A-Z in lower case."""
    raw = text.encode().lower() if lower else text.encode()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PART_BYTES) if len(raw) - at > PART_BYTES else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words that lie in a window of five found twice or more."""
    if len(ids) < WINDOW + 1:
        return 0
    if n_distinct < 6000:  # five numbers fit one 64-bit number
        keys = ids[:-4]
        for k in range(1, WINDOW):
            keys = keys * n_distinct + ids[k : len(ids) - 4 + k]
    else:
        pairs = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)[1]
        fours = np.unique(pairs[:-2] * (int(pairs.max()) + 1) + pairs[2:], return_inverse=True)[1]
        keys = fours[:-1] * n_distinct + ids[4:]
    _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[back] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[twice] += 1
    edge[twice + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def counted(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text; a NULL text is an empty one."""
    text = text or ""
    index: dict[bytes, int] = {}
    parts = []
    for words in word_parts(text):
        for w in dict.fromkeys(words):
            index.setdefault(w, len(index))
        parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(ids),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(index)),
        len(lines),
        len(index),
        sum(map(str.isupper, text)) if not text.isascii() else sum(map(text.count, UPPER)),
        text.count("!"),
    )


def rules() -> dict[str, tuple[Column, Column]]:
    """Name: (votes to reject, votes to keep); where neither holds the rule abstains.

    A sign of one kind of junk says nothing where it is missing, so most rules reject or
    abstain; the two rules that vote to keep look at several signs at once.
    """
    words, letters = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    symbols, bangs = F.col("n_symbols") / words, F.col("qr_bangs") / words
    upper, repeats = F.col("qr_upper") / letters, F.col("n_repeat_words") / words
    same_lines = F.col("n_dup_lines") / F.greatest("qr_lines", F.lit(1))
    distinct, length = F.col("qr_distinct") / words, F.col("word_chars") / words
    never = F.lit(False)
    return {
        "symbols": (symbols > 0.1, never),
        "bangs": (bangs > 0.2, never),
        "upper_case": (upper > 0.3, never),
        "repeats": (repeats > 0.2, never),
        "same_lines": (same_lines > 0.3, never),
        "distinct_words": ((F.col("n_words") >= 30) & (distinct < 0.25), never),
        "word_length": ((length < 2.5) | (length > 12), never),
        "length": (F.col("n_words") < 10, never),
        "clean": (never, (symbols < 0.02) & (bangs < 0.05) & (upper < 0.15) & (repeats <= 0.2)),
        "prose": (never, (length > 3) & (length < 9) & (symbols < 0.05) & (same_lines <= 0.3) & ((distinct > 0.35) | (F.col("n_words") >= 1000))),
    }


def count_texts(docs: DataFrame) -> DataFrame:
    """Every row without its text but with the counts of it; input columns named like these are replaced."""
    new = StructType.fromDDL(COUNTS)
    rows = docs.drop(*new.names)
    place = rows.columns.index("text")
    keep = [k for k, c in enumerate(rows.columns) if c != "text"]
    schema = StructType([*(rows.schema.fields[k] for k in keep), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(place)):
                part = batch.slice(start, stop - start)
                got = [counted(x) for x in part.column(place).to_pylist()]
                columns = [pa.array(c, pa.int64()) for c in zip(*got, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def vote(reject: Column, keep: Column) -> Column:
    """0 rejects, 1 keeps, 2 abstains."""
    return F.when(reject, 0).when(keep, 1).otherwise(2)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior of a good document and, per rule, class (bad, good) and vote, its probability.

    ``patterns``: one row of votes per pattern. Starts from the share of keeping votes and
    stops when the posterior stands still. Ties and empty tables give a prior of one half.
    """
    n_rules = patterns.shape[1]
    if not len(patterns):
        return 0.5, np.full((n_rules, 2, 3), 1 / 3)
    keeps, rejects = (patterns == 1).sum(1), (patterns == 0).sum(1)
    good = (keeps + 1) / (keeps + 3 * rejects + 2)
    one_hot = (patterns[:, :, None] == np.arange(3)).astype(float)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good])
        prior = float(np.clip(mass[1].sum() / mass.sum(), 1e-3, 1 - 1e-3))
        table = np.einsum("cp,prv->rcv", mass, one_hot) + 1
        table /= table.sum(2, keepdims=True)
        score = np.log(prior / (1 - prior)) + np.einsum("prv,rv->p", one_hot, np.log(table[:, 1] / table[:, 0]))
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return prior, table


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judge(docs: DataFrame) -> DataFrame:
    """Every row (without its text) with its counts, ``qr_posterior``, ``base_failed`` and ``kept``.

    ``kept`` is false where the base checks fail, else whether the posterior reaches one half.
    NULL and empty texts have no words and fail. Repeated rows stay repeated.
    """
    named = rules()
    counted_rows = staged(count_texts(docs), "quality-counts")
    votes = counted_rows.withColumns({f"__{name}": vote(*pair) for name, pair in named.items()})
    columns = [f"__{name}" for name in named]
    seen = votes.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(*columns).collect()
    patterns = np.array([r[:-1] for r in seen], int).reshape(len(seen), len(columns))
    prior, table = estimate(patterns, np.array([r[-1] for r in seen], float))
    ratio = np.log(table[:, 1] / table[:, 0])
    score = F.lit(float(np.log(prior / (1 - prior))))
    for k, c in enumerate(columns):
        score = score + F.element_at(F.array(*[F.lit(float(x)) for x in ratio[k]]), F.col(c) + 1)
    out = votes.withColumns({"qr_posterior": 1 / (1 + F.exp(-score)), "base_failed": base_failed()})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("qr_posterior") >= 0.5)).drop(*columns)


def contract(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior."""
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("qr_posterior").alias("posterior")
    )
