"""Substring deduplication, periodic runs and fill-in-the-middle against brute force, on odd tables too."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from assayer.llm import fim, periodic, substrings
from assayer.llm.wordstream import doc_starts

DOCS = "doc_id long, text string, ss_words string, pr_runs string, fim_form string, places string, n long, c0 string, bucket long"
WORD = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, pairs, parts=3):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", 1, "e", 2) for i, t in pairs], DOCS).repartition(parts)


def prose(n, rnd, size=60):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and very long texts, one long word, other scripts, white space, repeats inside and across texts."""
    rnd = random.Random(4)
    passage = " ".join(prose(30, rnd, 9000))
    long = " ".join(prose(40_000, rnd, 20_000))
    texts = [None, "", " \n\t\x0b ", "one", "x" * 200_000, "é😀 à\n日本 \r\n😀", long, long[:5000] + " " + passage, passage, f"a {passage}\nb", passage.upper()]
    texts += ["tick " * 300, "to and fro " * 70 + passage, f"{passage} {passage}", "<P> marked <M>", "a" * 4096 + "é" * 4096 + "😀\n" * 3, passage]
    return list(enumerate(texts))


# substrings


def removed_slowly(pairs, window):
    """(doc_id, words, words removed, kept text) of each row."""
    split = [(d, re.findall(WORD, t or "")) for d, t in pairs]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for (d, text), (_, w) in zip(pairs, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] != (d, i):
                gone |= set(range(i, i + window))
        out.append((str(d), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text or ""))
    return sorted(out)


def removed(docs, window):
    return sorted((str(r.doc_id), r.ss_words, r.ss_removed, r.text or "") for r in substrings.dedup_substrings(docs, window).collect())


def test_passages_of_odd_tables_equal_brute_force(spark, odd):
    pairs = [*odd, odd[8], (None, odd[8][1]), (9, odd[3][1]), (9, odd[12][1])]  # repeated rows, and ids that have two texts
    docs = table(spark, pairs)
    assert removed(docs, 20) == removed_slowly(pairs, 20)
    assert substrings.dedup_substrings(docs).columns == [c for c in docs.columns if c != "ss_words"] + ["ss_words", "ss_removed"]
    kept = {r.doc_id: r for r in substrings.contract(table(spark, odd)).collect()}
    for d, n, gone, text in removed_slowly(odd, 20):
        assert (kept[int(d)].n_words, kept[int(d)].n_removed, kept[int(d)].kept_sha256) == (n, gone, sha(" ".join(re.findall(WORD, text))))


@pytest.mark.parametrize(("window", "gathered", "spare"), [(6, 200, 1), (7, 50, 4), (5, 1 << 20, 4)])
def test_passages_equal_brute_force_whatever_the_sizes(spark, monkeypatch, window, gathered, spare):
    """Few counters, so that nearly every window is suspected; small parts, so that equal windows meet in no task; few words, so that much repeats."""
    monkeypatch.setattr(substrings, "GATHERED", gathered)
    monkeypatch.setattr(substrings, "SPARE", spare)
    monkeypatch.setattr(substrings, "LEAST_CLASSES", 3)
    rnd = random.Random(window)
    common = prose(40, rnd)
    pairs = []
    for d in range(160):
        own = prose(rnd.randrange(60), rnd, 3 if d % 7 == 0 else 60)
        a = rnd.randrange(30)
        pairs.append((rnd.randrange(10**6), " ".join(own[:20] + (common[a : a + 10] if d % 3 == 0 else []) + own[20:])))
    assert removed(table(spark, pairs, 7), window) == removed_slowly(pairs, window)


def test_one_passage_in_a_third_of_all_documents(spark):
    rnd = random.Random(8)
    passage = " ".join(prose(25, rnd, 9000))
    pairs = [(d, f"{' '.join(prose(20, rnd, 10**9))} {passage if d % 3 == 0 else ''} {' '.join(prose(20, rnd, 10**9))}") for d in range(3000)]
    docs = table(spark, pairs, 8)
    assert {(r.doc_id, r.ss_removed) for r in substrings.dedup_substrings(docs).collect()} == {(d, 25 if d % 3 == 0 and d else 0) for d in range(3000)}
    sent = substrings.candidates(docs.select("doc_id", "text").join(substrings.suspects(docs.select("doc_id", "text")), "doc_id").select("doc_id", "text", "places").coalesce(4), 20, 8)
    shipped = np.concatenate([np.frombuffer(r.c5, np.uint64) for r in sent.where("c0 IS NOT NULL").select("c5").collect()])
    assert len(shipped) - len(np.unique(shipped)) <= 4 * 6  # the windows of the passage leave each task once


def test_no_passages(spark):
    empty = spark.createDataFrame([], DOCS)
    assert substrings.contract(empty).count() == 0
    assert [r.ss_removed for r in substrings.dedup_substrings(table(spark, [(None, "a b c"), (1, None)])).collect()] == [0, 0]


def test_estimates_are_never_too_low():
    rnd = np.random.default_rng(2)
    hashes = rnd.integers(0, 2**32, 3000, np.uint64).astype(np.uint32)
    sketch = substrings.CountMin(1 << 10)
    for k in range(5):
        sketch.add(hashes[: 1000 * (k % 3 + 1)], 1 + k % 2)
    true = np.where(np.arange(3000) < 1000, 7, np.where(np.arange(3000) < 2000, 4, 1))
    assert (sketch.estimate(hashes) >= true).all()


def test_equal_hashes_of_other_windows_are_told_apart():
    whole = np.array([5, 5, 5, 5], np.uint64)
    first, later = substrings.later_ones(np.array([1, 2, 1, 2], np.uint64), whole, np.array([3, 1, 2, 1]), np.array([0, 4, 9, 5]))
    assert first.tolist() == [False, True, True, False] and later.tolist() == [True, False, False, True]


# runs


def runs_slowly(s, times=4, least=6):
    out = []
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                own = s[i : i + length]
                if not any(own[d:] == own[: length - d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def periodic_words(rnd, n, size):
    s = prose(n, rnd, size)
    for _ in range(rnd.randrange(4)):
        if n > 5:
            p, a = rnd.randrange(1, max(2, n // 4)), rnd.randrange(n)
            unit = prose(p, rnd, size)
            for i in range(rnd.randrange(n - a + 1)):
                s[a + i] = unit[i % p]
    return s


def test_automaton_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(1500):
        s = periodic_words(rnd, rnd.randrange(60), rnd.choice([1, 2, 2, 3, 5, 40]))
        assert periodic.runs_of(s) == runs_slowly(s), s
        assert periodic.runs_of(s, 3, 5) == runs_slowly(s, 3, 5), s


def test_stretches_lose_no_run():
    rnd = random.Random(2)
    for _ in range(500):
        docs = [periodic_words(rnd, rnd.randrange(80), rnd.choice([1, 2, 3, 5, 40])) for _ in range(rnd.randrange(1, 6))]
        words = np.array([int(x[1:]) * 7919 + 13 for d in docs for x in d], np.uint64)
        assert periodic.runs_of_documents(words, doc_starts([len(d) for d in docs])) == [runs_slowly(d) for d in docs]


def test_long_runs_and_runs_inside_runs():
    rnd = random.Random(3)
    unit = prose(500, rnd) + ["so"] * 9 + prose(200, rnd)
    got = periodic.runs_of(unit * 30)
    assert (0, 709 * 30, 709) in got and sum(r[1:] == (9, 1) for r in got) == 30
    assert periodic.runs_of(["again"] * 100_000) == [(0, 100_000, 1)]
    assert not periodic.stretches(np.array([hash(x) & 2**60 - 1 for x in prose(30_000, rnd, 500)], np.uint64), doc_starts([30_000]))


def test_runs_of_odd_tables(spark, odd):
    pairs = [*odd, odd[11], (None, odd[11][1])]
    docs = table(spark, pairs)
    out = periodic.collapse(docs)
    assert out.columns == [c for c in docs.columns if c != "pr_runs"] + ["pr_words", "pr_runs"]
    got = sorted((str(r.doc_id), r.pr_words, [tuple(x) for x in r.pr_runs], r.text or "") for r in out.collect())
    want = []
    for d, t in pairs:
        w = re.findall(WORD, t or "")
        runs = runs_slowly(w) if len(w) < 10_000 else []
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        want.append((str(d), len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t or ""))
    assert got == sorted(want)
    assert periodic.contract(spark.createDataFrame([], DOCS)).count() == 0


def test_query_of_runs_equals_brute_force(spark):
    rnd = random.Random(6)
    pairs = [(d, " ".join(periodic_words(rnd, rnd.randrange(120), 30))) for d in range(300)] + [(300, None), (301, ""), (None, "a " * 9)]
    got = {r.doc_id: r for r in periodic.contract(table(spark, pairs)).collect()}
    for d, t in pairs:
        w = re.findall(WORD, t or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_slowly(w)
        gone = {i for a, k, q in runs for i in range(a + q, a + k)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{k},{q}\n" for a, k, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))


# fill-in-the-middle


def filled_slowly(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if doc_id is None or not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_middles_equal_brute_force(spark, odd):
    texts = [t for _, t in odd] * 12 + ["$1 \\$2 {3}", "<P", "S><", "\n\n", "😀" * 5000, "a<P>b", "é"]
    pairs = [*enumerate(texts), (3, texts[3]), (None, "no id"), (None, None)]
    docs = table(spark, pairs)
    out = fim.transform(docs).withColumn("back", fim.restored(fim.F.col("fim_output"), fim.F.col("fim_form")))
    assert out.columns == [c for c in docs.columns if c != "fim_form"] + [*fim.ADDED, "back"]
    got = sorted((str(r.doc_id), r.text or "", r.fim_units, r.fim_form, str(r.fim_prefix), str(r.fim_middle), r.fim_output, r.back) for r in out.collect())
    slow = [(d, t or "", *filled_slowly(d, t)) for d, t in pairs]
    assert got == sorted((str(d), t, n, form, str(a), str(b), o, t) for d, t, n, form, a, b, o in slow)
    assert {x[3] for x in got} == {"plain", "psm", "spm"}
    assert fim.contract(spark.createDataFrame([], DOCS)).count() == 0


def test_all_forms_can_be_asked_for(spark, odd):
    docs = table(spark, odd)
    assert {r.fim_form for r in fim.transform(docs, plain_percent=100).collect()} == {"plain"}
    assert {r.fim_form for r in fim.transform(docs, plain_percent=0, spm_percent=100).where("text <> '' AND NOT contains(text, '<P>')").collect()} == {"spm"}
