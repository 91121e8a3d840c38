"""Corpus operators against brute force, on tables with nulls, empty and very long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayer.llm import bpe, chat, licenses, line_dedup, ngram_join, quality, suffixes, token_files, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, a string, cell long, key string, tokens string, rejected string, dc_items string, digest string"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PASSAGE = "seven grey herons stand along the quiet river bank while the evening light slowly fades over the distant hills"


def words(n, seed, size=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(size)}x{rnd.randrange(9)}" for _ in range(n))


def texts():
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    line = "This very line is repeated in several of the documents"
    return [
        None, "", " \n\t ", "one", "two words", base, base, " ".join(near), base.upper(), f"{line}\n{words(30, 2)}", f"  {line.upper()} \n{words(30, 3)}",
        f"{words(30, 4)}\n{line}\n{line}", words(40, 5) + " " + PASSAGE, PASSAGE, PASSAGE[:40], words(60_000, 6, 100_000), "x" * 200_000, "é" * 50 + " à la <|endoftext|> 日本 😀",
        "a  b \n c\t\t d", words(25, 7) + " " + words(25, 7), "!! ## ** $$ %% && || << >>", "Released under the MIT License.",
        words(20, 8) + " Licensed under the Apache License, Version 2.0. " + words(20, 9),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, "a", 2, "k", "t", "r", "d", "g") for i, t in enumerate(texts())]
    rows += [rows[5], (None, texts()[5], None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "two words"), (10, PASSAGE), (None, "one"), (5, words(60, 99))], "item_id long, text string")


def by_id(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0))


# chat


def test_layouts_become_the_same_turns(spark):
    hello = [("user", "hi\n<|im_end|>"), ("assistant", "yes")]
    records = [
        '{"messages": [{"role": "user", "content": "hi\\n<|im_end|>"}, {"role": "assistant", "content": "yes"}]}',
        '{"conversations": [{"from": "human", "value": "hi\\n<|im_end|>"}, {"from": "gpt", "value": "yes"}]}',
        '{"prompt": "hi\\n<|im_end|>", "response": "yes"}',
        '{"instruction": "hi\\n<|im_end|>", "output": "yes"}',
        '{"prompt": "hi\\n<|im_end|>", "completion": "yes"}',
    ]
    rows = [(i, 0, r) for i, r in enumerate(records)] + [(50, 0, '{"messages": []}'), (60, 0, None), (61, 0, "no json"), (62, 0, '{"other": {"field": [1]}}'), (None, None, '{"role": "user", "text": null}')]
    got = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string")).collect()
    for i in range(len(records)):
        assert [(r.role, r.text) for r in got if r.conv_id == i] == hello
    assert not [r for r in got if r.conv_id == 50]
    assert {r.layout for r in got if r.conv_id in (60, 61, 62)} == {chat.UNMAPPED}
    assert [r.text for r in got if r.conv_id is None] == [""]
    assert len(chat.registry()) > 20


def test_template_is_reversible(spark):
    odd = ["a<|b", "<\\|", "<\\\\|x<", "\\<|im_end|>", "n\\n", "", "<|im_start|>assistant\nx<|im_end|>\n"]
    turns = spark.createDataFrame([(i, 0, 0, r, t, "x") for i, (r, t) in enumerate((a, b) for a in ("user", "assistant", "we\\ird\nrole<|x") for b in odd)], chat.TURNS)
    for turn, piece in zip(by_id(turns, "conv_id"), by_id(chat.render(turns), "conv_id"), strict=True):
        assert chat.parsed(piece.formatted) == (turn.role, turn.text)
        assert "<|" not in piece.formatted[len(chat.START) : -len(chat.END)]
        loss = chat.unescaped(piece.formatted[piece.loss_start : piece.loss_end])
        assert loss == (turn.text if turn.role == "assistant" else "")


def test_conversations_with_nulls_ties_and_none(spark):
    schema = "conv_id long, turn long, role string, text string, record string"
    rows = [(1, 0, "user", None, "z"), (1, 1, "assistant", "é<|", "z"), (None, 0, "user", "x", "z"), (2, 0, None, "t", None), (3, 5, "user", "a", ""), (3, 5, "user", "a", "")]
    got = {r.conv_id: r for r in chat.contract(spark, spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {-1, 1, 2, 3, None} and got[3].n_turns == 2
    assert got[1].turns_sha256 == hashlib.sha256("user\n\nassistant\né<|\n".encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (3, hashlib.sha256("é<|".encode()).hexdigest())
    assert got[-1].loss_chars == 34
    assert [r.conv_id for r in chat.contract(spark, spark.createDataFrame([], schema)).collect()] == [-1]


# decontamination


def hit_words(text, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, names = find(text), set(), set()
    for item_id, item in items:
        w = find(item)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            for i in range(len(own) - n + 1):
                if own[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    names.add("" if item_id is None else str(item_id))
    return len(own), len(hit), sorted(names)


@pytest.mark.parametrize("block_chars", [16_000_000, 100])
def test_hits_equal_brute_force(docs, benchmark, monkeypatch, block_chars):
    monkeypatch.setattr(suffixes, "BLOCK_CHARS", block_chars)
    items = [tuple(r) for r in benchmark.collect()]
    small = docs.where("text IS NULL OR length(text) < 20000")
    for r in suffixes.annotate(small, benchmark).collect():
        assert (r.dc_words, sum(h.end - h.start for h in r.dc_hits), sorted(r.dc_items)) == hit_words(r.text, items), r.doc_id
    assert suffixes.decontaminate(docs, benchmark).columns == docs.columns


def test_contaminated_documents_go_and_others_stay(docs, spark):
    kept = {r.doc_id for r in suffixes.decontaminate(docs, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")).collect()}
    assert kept == {*range(len(texts())), None} - {12, 13}


def test_longest_matches_name_a_place(docs, benchmark):
    got = {r.item_id: r for r in suffixes.longest_matches(docs, benchmark).collect()}
    assert (got["1"].length, got["1"].doc_id, got["1"].doc_start, got["1"].item_start) == (19, 12, 40, 0)
    assert (got["4"].length, got["4"].doc_id) == (2, 4) and "5" not in got


def test_decontamination_of_nothing(docs, empty, spark, benchmark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert suffixes.contract(empty, benchmark).count() == 0
    assert {r.n_hit for r in suffixes.contract(docs, none).collect()} == {0}


# quality


def counted_slowly(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_equal_brute_force(docs, empty):
    for r in quality.count_texts(docs.withColumn("again", docs.text)).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counted_slowly(r.again), r.doc_id
    assert quality.contract(empty).count() == 0
    many = np.random.default_rng(1).integers(0, 7000, 9000)
    many[5000:5020] = many[100:120]
    text = " ".join(map(str, many))
    assert quality.counted(text)[4] == counted_slowly(text)[4]


def test_rules_estimate_themselves(spark):
    rnd = np.random.default_rng(3)
    good = rnd.random(6000) < 0.8
    right = [0.95, 0.9, 0.7]
    votes = np.stack([np.where(rnd.random(6000) < 0.3, 2, np.where(rnd.random(6000) < p, good, ~good)) for p in right], 1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, table = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.06
    accuracy = table[:, 1, 1] / (table[:, 1, 0] + table[:, 1, 1])
    assert accuracy[0] > accuracy[2] + 0.1 and abs(accuracy[1] - 0.9) < 0.08


def test_junk_goes_and_prose_stays(spark):
    rows = [(i, words(150, i, 5000)) for i in range(60)] + [(100 + i, " | ".join(words(80, i).split())) for i in range(8)] + [(200 + i, words(5, i)) for i in range(4)]
    got = {r.doc_id: r.kept for r in quality.contract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in got if i >= 100)


# lines


def lines_slowly(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    held = {}
    for doc_id, text in rows:
        for x in (text or "").split("\n"):
            if doc_id is not None and len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(doc_id)
    gone = {k: max(d) for k, d in held.items() if len(d) >= 3}
    out = []
    for doc_id, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if doc_id is None or gone.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("bits", [1 << 24, 1 << 3])
def test_lines_equal_brute_force(docs, empty, monkeypatch, bits):
    """Also with filters so full that every line is suspected."""
    monkeypatch.setattr(line_dedup, "CLASS_BITS", bits)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = line_dedup.dedup_lines(docs)
    got = sorted((str(r.doc_id), r.ld_lines, r.ld_dropped, r.text or "") for r in out.collect())
    assert got == sorted((str(d), n, g, t) for d, n, g, t in lines_slowly(rows))
    assert line_dedup.contract(empty).count() == 0


def test_bloom_filters_lose_nothing():
    rnd = np.random.default_rng(5)
    seen, hashes = line_dedup.SeenTwice(1 << 16), rnd.integers(0, 2**63, 5000, np.uint64)
    none = np.zeros(0, np.uint64)
    first = seen.add(hashes, none)
    assert len(first) < 100
    again = seen.add(hashes[:500], hashes[4000:4100])
    assert set(again) | set(first) >= {*hashes[:500].tolist(), *hashes[4000:4100].tolist()}


def test_nearly_full_filters_give_out_every_repeated_hash():
    rnd = np.random.default_rng(6)
    hashes, none = np.unique(rnd.integers(0, 2**64, 40_000, np.uint64)), np.zeros(0, np.uint64)
    seen, given = line_dedup.SeenTwice(1 << 16), set()
    for part in np.array_split(hashes, 8):
        given |= set(seen.add(part, none).tolist())
    for part in np.array_split(rnd.permutation(hashes), 8):
        given |= set(seen.add(part[: len(part) // 2], part[len(part) // 2 :]).tolist())
    assert given == set(hashes.tolist())
    assert seen.repeated().tolist() == hashes.tolist()


def test_classes_of_hashes_follow_lines_and_leave_every_place_of_a_filter(spark, monkeypatch):
    hashes = np.random.default_rng(7).integers(0, 2**64, 200_000, np.uint64)
    cls = line_dedup.class_of(hashes, 16)
    assert set(cls.tolist()) == set(range(16))
    places = line_dedup.probes(hashes[cls == 3], 1 << 10)
    assert all(len(np.unique(p)) == 1 << 10 for p in places)
    long = spark.createDataFrame([(1, "\n".join(f"line number {k} of a long document" for k in range(500))), (2, None), (3, "short")], "doc_id long, text string")
    assert line_dedup.most_keys(long, 20) == 500
    monkeypatch.setattr(line_dedup, "CLASS_BITS", 1 << 8)
    monkeypatch.setattr(line_dedup, "CLASS_KEYS", 50)
    many = spark.createDataFrame([(k, long.first().text) for k in range(4)], "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.ld_dropped for r in line_dedup.dedup_lines(many).collect()} == {0: 500, 1: 500, 2: 500, 3: 0}


# toxicity


def test_chain_finds_toxic_texts_and_leaves_others(spark):
    rnd = random.Random(4)
    bad = ["idiot", "moron", "scum", "trash", "pathetic", "worthless"]
    make = lambda i, toxic: words(60, i, 3000) + ((" " + " ".join(rnd.sample(bad, 3))) if toxic else "")
    rows = [(i, make(i, i % 8 == 0)) for i in range(600)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, words(30_000, 7))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.contract(docs, labels).collect()}
    held_out = range(400, 600)
    assert np.mean([got[i].rejected == (i % 8 == 0) for i in held_out]) > 0.98
    assert not got[1000].rejected and not got[1001].rejected and not got[1002].rejected
    kept = toxicity.without_toxic(docs, docs, labels)
    assert kept.columns == docs.columns and 8 not in {r.doc_id for r in kept.collect()}


def test_chain_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(r.rejected for r in toxicity.contract(docs, none).collect())
    assert toxicity.without_toxic(empty, empty, none).count() == 0
    assert toxicity.score(docs, toxicity.fit_chain(docs, none)).count() == docs.count()


def test_later_models_get_out_of_fold_probabilities():
    rnd = random.Random(2)
    texts_ = [{b"idiot", *(b"w%d" % rnd.randrange(50) for _ in range(9))} if i % 3 == 0 else {b"w%d" % rnd.randrange(50) for _ in range(9)} for i in range(300)]
    toxic = np.array([i % 3 == 0 for i in range(300)])
    models, threshold = toxicity.train([toxicity.hashed(x) for x in texts_], [toxic, toxic, toxic])
    chain = toxicity.Chain(models, threshold, {w for x in texts_ for w in x})
    assert [len(m.earlier) for m in models] == [0, 1, 2]
    assert (chain.probabilities("idiot w1 w2")[2] >= threshold) and chain.probabilities("w1 w2 w3")[2] < threshold


# licenses


def test_licenses_whole_changed_and_missing(spark):
    mit = dict(licenses.TEMPLATES)["mit"].split()
    changed = [*mit[:30], "altered", *mit[31:]]
    broken = [w if k % 6 else "altered" for k, w in enumerate(mit)]
    rows = [(1, words(33, 1) + " " + " ".join(mit)), (2, "x " + " ".join(changed)), (3, " ".join(broken)), (4, None), (5, ""), (6, "Released under the MIT License."), (7, "of the and in to of the and"), (8, words(50_000, 3) + " Released, under THE mit license")]
    got = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").withColumnRenamed("x", "x")).collect()}
    assert set(got) == {(1, "mit"), (2, "mit"), (6, "mit-line"), (8, "mit-line")}
    assert got[1, "mit"].n_hit == got[1, "mit"].n_shingles and got[1, "mit"].first_word == 33
    assert got[2, "mit"].n_hit == got[2, "mit"].n_shingles - 5
    assert got[8, "mit-line"].first_word == 50_000


def test_licenses_of_odd_tables(docs, empty):
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == {(21, "mit-line"), (22, "apache-2.0-line")}
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, [("short", "too few words")])


# token files


def test_token_files_hold_what_the_library_encodes(docs, empty, spark, tmp_path):
    library = Tokenizer.from_file(WORD_BPE)
    files = token_files.write(docs, WORD_BPE, f"file://{tmp_path}/out", end_id=2, sequence=64)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    start = 0
    got = sorted(token_files.read(files).collect(), key=lambda r: r.start)
    for (named, doc_id, text), r in zip(rows, got, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id if named else None, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = token_files.SequenceFile(files.first().path)
    ids, mask = one.batch(0)
    assert ids.base is not None and len(ids) % 64 == 0 and mask[0].as_py()
    assert token_files.written_and_read(spark, empty, WORD_BPE, 2).count() == 0


# archives


def test_archives_come_back(spark):
    big = "<p>é" + "x" * 2000
    rows = [(1, "http://a", big), (2, "http://b\nX: y", big), (3, None, None), (4, "u", "short"), (5, "u", "short"), (None, "u", big), (6, "u", "y" * 100_000)]
    got = {r.page_id: r for r in warc.contract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    assert got[None].record_type == "response" and got[5].refers_to is None and got[3].payload_bytes == 0
    assert got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[1].payload_bytes == len(big.encode())
    assert warc.contract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Held:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


def records(n=6):
    return [warc.record_bytes(k, f"u{k}", p := (b"payload %d " % k) * 50, hashlib.sha1(p).hexdigest(), None) for k in range(n)]


def packed(raw):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_skips_damage_and_logs_it(compress):
    parts = [packed(r) if compress else r for r in records()]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    whole = b"".join(parts)
    read = lambda raw: list(warc.Salvager(Held(raw)).entries())
    assert [e.headers["warc-record-id"] for e in read(whole)] == [f"<urn:page:{k}>" for k in range(6)]
    damaged = bytearray(whole)
    middle = (ends[1] + ends[2]) // 2
    damaged[middle : middle + 9] = b"\0" * 9
    got = read(bytes(damaged))
    assert [e.headers.get("warc-record-id") for e in got] == ["<urn:page:0>", "<urn:page:1>", None, "<urn:page:3>", "<urn:page:4>", "<urn:page:5>"]
    assert (got[2].start, got[2].stop) == (ends[1], ends[2]) and got[2].reason
    cut = read(whole[: ends[4] + 20])
    assert [e.reason is None for e in cut] == [True] * 5 + [False] and cut[-1].stop == ends[4] + 20
    junk = read(b"junk" + whole[: ends[0]] + b"junk\n" + whole[ends[0] :])
    assert [e.reason is None for e in junk] == [False, True, False] + [True] * 5
    assert read(b"") == [] and [e.reason is not None for e in read(b"nothing here")] == [True]


# similarity join


def classes_slowly(rows, n, percent):
    sets, parent = {}, {}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        parent[doc_id] = doc_id
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed, n=120):
    """Copies of copies with a few changed words, of several lengths, and texts that share a long passage."""
    rnd = random.Random(seed)
    out = []
    for g in range(12):
        base = words(rnd.choice([3, 5, 9, 14, 30, 60, 200, 600]), 1000 * seed + g).split()
        for _ in range(n // 12):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = f"c{rnd.randrange(10**6)}"
            out.append(" ".join(copy))
            base = copy if rnd.random() < 0.5 else base
    out += [words(25, 5000 + k) + " " + PASSAGE for k in range(30)]
    return out


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_classes_equal_brute_force(spark, docs, n, percent):
    rows = [(i, t) for i, t in enumerate([*texts(), *near_copies(n)])]
    want = classes_slowly(rows, n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, percent).collect()}
    assert got == want
    odd = ngram_join.similar(docs, n, percent).collect()
    assert len(odd) == docs.count() and all(r.component_id is None for r in odd if r.doc_id is None)


def test_links_equal_brute_force_in_blocks():
    rows = near_copies(9, 240)
    sets = [ngram_join.shingle_set(t, 4) for t in rows]
    blocks = [k % 3 for k in range(len(rows))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(3):
        for j in range(i, 3):
            some = [k for k in range(len(rows)) if blocks[k] in (i, j)]
            for a, b in ngram_join.links([sets[k] for k in some], [blocks[k] if i != j else 0 for k in some], 85):
                x, y = find(some[a]), find(some[b])
                parent[max(x, y)] = min(x, y)
    want = classes_slowly(list(enumerate(rows)), 4, 85)
    assert all(find(k) == want[k][1] for k in range(len(rows)))


def test_long_lists_are_passed_on(monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_HELD", 50)
    monkeypatch.setattr(ngram_join, "HOT", 20)
    lists, out = ngram_join.Lists(), []
    for k in range(30):
        sig = np.array([7, 100 + k, 200], np.uint64)
        out += list(lists.add(sig, np.full(3, k, np.int64), np.zeros(3, np.uint32)))
    out += list(lists.rest())
    found = {}
    for sig, doc, _, length in out:
        for s, d, n in zip(sig.tolist(), doc.tolist(), length.tolist(), strict=True):
            found.setdefault(s, []).append((d, n))
    assert set(found) == {7, 200}
    assert sorted(d for d, _ in found[7]) == list(range(30)) and len({n for _, n in found[7]}) == 1


def test_one_of_each_keeps_one(spark, docs, empty):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 6 not in ids and 8 not in ids and None in ids
    assert ngram_join.one_of_each(empty).count() == 0 and ngram_join.contract(empty).count() == 0


# byte pairs


def test_ids_equal_the_library(docs, empty):
    library = Tokenizer.from_file(BYTE_BPE)
    for r in bpe.encode(docs, BYTE_BPE).collect():
        assert np.frombuffer(r.tokens, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids, r.doc_id
    for r in bpe.decode(bpe.encode(docs, BYTE_BPE), BYTE_BPE).collect():
        assert r.decoded == (r.text or "")
    assert bpe.digests(empty, BYTE_BPE).count() == 0


def test_any_text_is_encoded_like_the_library():
    rnd = random.Random(8)
    some = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", "日本", "!", "́", "Ａ", " 's", "😀", "\r\n", "İ", "Σ", "ß", "²", "_"]
    texts_ = ["".join(rnd.choice(some) for _ in range(rnd.randrange(30))) for _ in range(3000)] + ["foo " + "".join(rnd.choice("abcdefghijkxzé") for _ in range(3000))]
    for by, kind in ((bpe.splitter(BYTE_BPE), "<u4"), (token_files.encoder(WORD_BPE), "<u2")):
        for ids, e in zip(by.encode_many(texts_), by.library.encode_batch(texts_, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, kind).tolist() == e.ids
    by = bpe.splitter(BYTE_BPE)
    for ids in ([50256, 220], [255], [30, 130, 188, 256], []):
        assert by.decode(np.array(ids, "<u4").tobytes()) == by.library.decode(ids, skip_special_tokens=False)


def test_cuts_are_certain():
    by = bpe.splitter(BYTE_BPE)
    raw = np.frombuffer("wordqxzzjq".encode(), np.uint8)
    starts = by.fragments(raw, np.array([len(raw)]))
    assert all(not by.inside[raw[s - 1], raw[s]] for s in starts[1:]) and len(starts) > 1
