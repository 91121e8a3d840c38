"""Periodic runs of words: a suffix automaton whose link tree is kept in preferred paths.

A run is a stretch of words with smallest period q, as long as it can be, that is repeated
often enough (here four times, six words at least). Words are appended to a suffix automaton
one by one. The path from the state of the new prefix to the root of the link tree holds all its
suffixes; it falls into segments, and all states of a segment ended last at the same word. The
access of a link-cut tree gives the segments of the path and paints the whole path with
the new end. Where a segment ended d words ago and its longest suffix has at least d
words, that suffix and its last occurrence touch or overlap: a square of period d. The longest
suffix of the segment reaches as far to the left as the period goes, so the square is at once a run up
to the new word, and later words carry its end on. The last occurrence is the nearest, so
d is the smallest period. A word changes a logarithmic number of segments, all told.

Most texts have no run. Every place of a run behind its first period starts a sequence of four
words that was seen at most q words before, so such places stand in stretches of at least 3 q - 3. These
stretches are found with one sort over all documents of a slice; only they, with what
a run could add at their ends, go through the automaton. No run is lost, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.llm.common import text_slices
from assayer.llm.ngram_join import mix
from assayer.llm.wordstream import doc_starts, kept_words, spaced, word_hashes

#: Times a period must fit into a run, and words a run must have.
TIMES, LEAST = 4, 6
#: Words of the sequences that a stretch is found by.
GRAM = 4
ADDED = "pr_words long, pr_runs array<struct<start: long, length: long, period: long>>"


class LinkTree:
    """The link tree of a suffix automaton; preferred paths are splay trees, and the root of each knows the last end of its states.

    State 0, the root of the link tree, is in no path.
    """

    def __init__(self):
        self.left, self.right, self.up, self.last = [-1], [-1], [-1], [-1]

    def add(self, parent: int) -> int:
        """A new leaf below a state."""
        self.left.append(-1)
        self.right.append(-1)
        self.up.append(parent)
        self.last.append(-1)
        return len(self.up) - 1

    def insert_above(self, state: int) -> int:
        """A new state between a state and its parent, with the same last end."""
        self.splay(state)
        above, new = self.left[state], self.add(state)
        self.left[new] = above
        if above >= 0:
            self.up[above] = new
        self.left[state] = new
        return new

    def rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b >= 0:
            up[b] = y
        up[y] = x
        up[x] = z

    def splay(self, x: int) -> None:
        """Make a state the root of its path's tree."""
        left, right, up, rotate = self.left, self.right, self.up, self.rotate
        top, y = x, up[x]
        while left[y] == x or right[y] == x:
            z = up[y]
            top = y
            if z >= 0 and (left[z] == y or right[z] == y):
                top = z
                rotate(y if (left[z] == y) == (left[y] == x) else x)
            rotate(x)
            y = up[x]
        self.last[x] = self.last[top]

    def access(self, leaf: int, end: int) -> Iterator[tuple[int, int]]:
        """Paint the path from a leaf to the root with ``end``; gives (deepest state, last end) of each segment before, from below."""
        left, right, up, last, splay = self.left, self.right, self.up, self.last, self.splay
        lower, x = leaf, up[leaf]
        while x > 0:
            if left[up[x]] == x or right[up[x]] == x:
                splay(x)
            before = last[x]
            yield x, before
            if right[x] >= 0:
                last[right[x]] = before
            right[x] = lower
            lower, x = x, up[x]
        last[lower] = end


def runs_of(sequence: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence, by start, then period."""
    steps, link, length, tree = [{}], [-1], [0], LinkTree()
    found: dict[tuple[int, int], int] = {}
    state = 0
    for i, word in enumerate(sequence):
        new = tree.add(0)
        steps.append({})
        link.append(0)
        length.append(length[state] + 1)
        p = state
        while p >= 0 and word not in steps[p]:
            steps[p][word] = new
            p = link[p]
        if p >= 0:
            q = steps[p][word]
            if length[p] + 1 < length[q]:
                middle = tree.insert_above(q)
                steps.append(steps[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = middle
                while p >= 0 and steps[p].get(word) == q:
                    steps[p][word] = middle
                    p = link[p]
                q = middle
            link[new] = tree.up[new] = q
        for x, end in tree.access(new, i):
            period, long = i - end, length[x]
            if long >= (times - 1) * period and long + period >= least:
                found[i - long - period + 1, period] = i
        state = new
    return sorted((start, end - start + 1, period) for (start, period), end in found.items())


def stretches(words: np.ndarray, starts: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int]]:
    """First and last place of every stretch that may hold the later periods of a run, over the words of several documents."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return []
    grams = words[:n].copy()
    for k in range(1, GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[k : n + k]
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    grams = mix(grams) ^ mix(doc[:n].astype(np.uint64) + np.uint64(1))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    back = np.zeros(n, np.int64)  # words to the place before that starts alike; 0: none
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    inside = doc[:n] == doc[GRAM - 1 :]
    places = np.flatnonzero((back > 0) & inside)
    while len(places):
        new = np.diff(places, prepend=places[0] - 2) > 1
        new[1:] |= doc[places[1:]] != doc[places[:-1]]
        first = np.flatnonzero(new)
        sizes = np.diff(first, append=len(places))
        # a stretch of m places can belong to periods of up to (m + GRAM - 1) / (times - 1) words
        longest = (sizes + GRAM - 1) // (times - 1)
        ok = (back[places] <= np.repeat(longest, sizes)) & np.repeat(sizes >= max(1, least - GRAM), sizes)
        if ok.all():
            return [(int(places[f]), int(places[f + s - 1])) for f, s in zip(first.tolist(), sizes.tolist(), strict=True)]
        places = places[ok]
    return []


def runs_of_documents(words: np.ndarray, starts: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, over the words of several; ``starts`` as :func:`doc_starts` gives it."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts) - 1)]
    for a, b in stretches(words, starts, times, least):
        d = int(np.searchsorted(starts, a, side="right")) - 1
        base, end = int(starts[d]), int(starts[d + 1])
        low = max(base, a - (b - a + GRAM) // (times - 1))
        region = np.unique(words[low : min(end, b + GRAM)], return_inverse=True)[1]
        for start, length, period in runs_of(region.tolist(), times, least):
            # a run belongs to the stretch of its later periods; any other is seen from another stretch, or cut
            if a <= low + start + period and low + start + length - GRAM <= b:
                out[d].append((low + start - base, length, period))
    return [sorted(x) for x in out]


def collapse(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """All rows, a text with runs without the repeated periods; ``pr_words`` and ``pr_runs`` (by start, then period) tell of the text before.

    A word is dropped where a run holds it behind its first period; the rest of such a text is joined by
    single spaces. A text without runs stays as it is. NULL and empty texts, and texts
    without words, have no runs. Each row stands for itself: repeated rows give equal results and a NULL doc_id
    changes nothing. Words are equal where their 64-bit hashes are. Input columns named like the new ones are replaced.
    No row moves. Memory follows the longest text and its periodic part.
    """
    rows = docs.drop("pr_words", "pr_runs")
    place = rows.columns.index("text")
    added = StructType.fromDDL(ADDED)
    schema = StructType([*rows.schema.fields, *added.fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch.column(place)):
                part = batch.slice(start, stop - start)
                texts = part.column(place).to_pylist()
                hashed = [word_hashes(t) for t in texts]
                sizes = [len(h) for h in hashed]
                found = runs_of_documents(np.concatenate(hashed), doc_starts(sizes), times, least)
                for k, runs in enumerate(found):
                    if runs:
                        edge = np.zeros(sizes[k] + 1, np.int64)
                        for at, length, period in runs:
                            edge[at + period] += 1
                            edge[at + length] -= 1
                        texts[k] = kept_words(texts[k], np.cumsum(edge[:-1]) == 0)
                columns = list(part.columns)
                columns[place] = pa.array(texts, pa.string())
                told = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(told, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text), every tenth by the checksum of its id made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    some = some.select("*", F.inline(F.array(F.struct(F.size("w").alias("n")))))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")
    some = some.select("*", F.inline(F.array(F.struct(a.alias("a")))))
    rest = F.col("n") - F.col("a")
    p = (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")
    unit = F.slice("w", F.col("a") + 1, p)
    cycle = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / p).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), cycle), " ")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def steepest(runs: Column) -> Column:
    """The run with the greatest length by period; of equal ones the first. NULL where there is none."""
    more = lambda a, x: x["length"] * a["period"] > a["length"] * x["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, x: F.when(more(a, x), x).otherwise(a))


def contract(docs: DataFrame) -> DataFrame:
    """Per document, every tenth with a planted period: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    out = collapse(with_planted_periods(docs.select("doc_id", "text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    text = F.array_join(F.transform("pr_runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = out.select("doc_id", "pr_runs", F.sha2(spaced(F.col("text")), 256).alias("collapsed_sha256"), steepest(F.col("pr_runs")).alias("best"))
    return out.select(
        "doc_id",
        F.size("pr_runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
