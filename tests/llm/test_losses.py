"""Inputs on which nothing may get lost: odd records, long addresses, repeated page ids, long insertions, many templates."""

import hashlib
import random

import pytest

from assayer.llm import chat, licenses, warc

RECORD = "conv_id long, turn long, record string"


@pytest.mark.parametrize(
    "record",
    [
        '{"messages": ["keep me"]}',
        '{"message.role": "user", "message.content": "keep me"}',
        '{"messages[].role": "user", "messages[].content": "keep me"}',
        '{"messages": [{"role": "user", "content": "a"}, "keep me"]}',
        '{"messages": [[{"role": "user", "content": "keep me"}]]}',
        '{"messages": [], "note": "keep me"}',
        '{"messages": {"role": "user", "content": "keep me"}}',
        '{"messages": [{"role": "user", "content": {"text": "keep me"}}]}',
        '{"role": "user", "text": "keep me", "text": "and me"}',
        '{"messages": [{}]}',
        "[" * 100_000 + '"keep me"' + "]" * 100_000,
        '{"a":' * 2_000 + '"keep me"' + "}" * 2_000,
    ],
)
def test_records_outside_the_layouts_keep_their_text(spark, record):
    [row] = chat.canonical_turns(spark.createDataFrame([(1, 0, record)], RECORD)).collect()
    assert (row.layout, row.text) == (chat.UNMAPPED, record)


def test_records_without_turns_give_none(spark):
    rows = [(1, 0, '{"messages": []}'), (2, 0, '{"conversations": [], "conv_id": 2}'), (3, 0, '{"messages": [null]}')]
    got = chat.canonical_turns(spark.createDataFrame(rows, RECORD)).collect()
    assert [(r.conv_id, r.layout) for r in got] == [(3, chat.UNMAPPED)]


def test_paths_tell_marks_in_names_from_structure():
    assert chat.field_paths({"a": {"b": 1}}) == {"a.b"} and chat.field_paths({"a.b": 1}) == {"a\\.b"}
    assert chat.field_paths({"a": []}) == {"a[]:none"} and chat.field_paths({"a": [1]}) == {"a[]"} and chat.field_paths({"a[]": 1}) == {"a\\[\\]"}
    assert chat.field_paths({"a": {}, "b": [{}]}) == {"a:empty", "b[]:empty"} and chat.field_paths({"a:none": 1}) == {"a\\:none"}
    assert chat.field_paths({"a\nb": 1, "a": None}) == {"a\\nb"} and chat.field_paths(None) == set()


def archives(spark, tmp_path, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    return warc.write(pages, f"file://{tmp_path}/warc")


def test_an_address_of_any_length_is_read_again(spark, tmp_path):
    rows = [(1, "http://x/" + "a" * 2_000_000, "first"), (2, "http://y/", "second"), (3, "b" * 1_100_000, None)]
    got = warc.read(archives(spark, tmp_path, rows)).collect()
    assert {(r.kind, r.record_id, r.target, bytes(r.payload).decode()) for r in got} == {("record", f"<urn:page:{i}>", u, h or "") for i, u, h in rows}


def test_a_long_header_is_read_where_records_are_not_compressed(tmp_path):
    from pyarrow import fs

    body = [warc.record_bytes(k, "u" * n, b"payload", hashlib.sha1(b"payload").hexdigest(), None) for k, n in enumerate((5, 3_000_000, 70_000))]
    raw = body[0] + b"WARC/1.1 junk" * 2000 + body[1] + b"WARC/1.1\r\n" + body[2] + b"WARC/1.1 no end" * 5000
    (tmp_path / "x.warc").write_bytes(raw)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc")) as file:
        entries = list(warc.Salvager(file).entries())
    assert [len(e.headers["warc-target-uri"]) for e in entries if e.reason is None] == [5, 3_000_000, 70_000]
    assert [a.stop for a in entries[:-1]] == [b.start for b in entries[1:]] and entries[-1].stop == len(raw)


def test_payloads_of_a_repeated_page_id_all_stay(spark, tmp_path):
    x, y = "x" * 1500, "y" * 1500
    rows = [(1, "a", x), (2, "b", x), (1, "c", y), (2, "d", x), (None, "e", x)]
    got = warc.read(archives(spark, tmp_path, rows)).collect()
    seen = sorted((r.target, r.record_type, r.refers_to or "", bytes(r.payload).decode()) for r in got)
    assert seen == [("a", "revisit", "<urn:page:2>", ""), ("b", "response", "", x), ("c", "response", "", y), ("d", "response", "", x), ("e", "response", "", x)]


def held(text, template):
    """Distinct shingles of the template, and those that the text holds."""
    cut = lambda s: [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    own = grams(cut(template))
    return len(own), len(own & grams(cut(text)))


def test_licenses_equal_containment_by_brute_force(spark):
    """Insertions of any length, changed words, several licenses, scattered words."""
    rnd = random.Random(1)
    filler = lambda n: " ".join(f"z{rnd.randrange(10**6)}" for _ in range(n))
    texts = [None, "", "Released under", "é" * 100]
    for _, template in licenses.TEMPLATES:
        w = template.split()
        for n in (10, 20, 40, 200, 1000):
            texts.append(" ".join([*w[: len(w) // 2], filler(n), *w[len(w) // 2 :]]))
        for n in range(1, 7):
            changed = list(w)
            for _ in range(n):
                changed[rnd.randrange(len(w))] = filler(1)
            texts.append(filler(9) + " " + " ".join(changed))
            cuts = sorted(rnd.randrange(len(w)) for _ in range(n))
            texts.append(" ".join(f"{' '.join(w[a:b])} {filler(30)}" for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True)))
    texts += [f"{a} {filler(50)} {b}" for (_, a), (_, b) in zip(licenses.TEMPLATES, licenses.TEMPLATES[1:], strict=False)]
    texts += [" ".join(rnd.sample(t.split(), len(t.split()))) for _, t in licenses.TEMPLATES]
    rows = list(enumerate(texts))
    got = {(r.doc_id, r.license): (r.n_shingles, r.n_hit) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {}
    for i, text in rows:
        for name, template in licenses.TEMPLATES:
            n, hit = held(text or "", template)
            if hit * 10 >= 8 * n:
                want[i, name] = (n, hit)
    assert got == want and sum(k[1] == "apache-2.0" for k in got) > 10


def test_places_of_a_license(spark):
    line = dict(licenses.TEMPLATES)["mit-line"]
    rows = [(1, f"one two {line} three {line}"), (None, line), (None, f"x {line}"), (1, "nothing")]
    got = {r.doc_id: (r.first_word, r.n_places) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 2), None: (0, 2)}


@pytest.mark.parametrize("bound", [50_000, 100])
def test_many_templates(spark, monkeypatch, bound):
    """50,000 words of templates, joined by shuffles; with and without the filter by vocabulary."""
    monkeypatch.setattr(licenses, "BROADCAST_WORDS", 20_000)
    monkeypatch.setattr(licenses, "MOST_VOCABULARY", bound)
    rnd = random.Random(2)
    templates = [(f"t{k}", " ".join(f"w{rnd.randrange(3000)}" for _ in range(100))) for k in range(500)]
    rows = [(k, f"before {templates[7 * k][1]} after") for k in range(40)] + [(100, "nothing at all of that kind")]
    got = {(r.doc_id, r.license, r.n_hit) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert got == {(k, f"t{7 * k}", held(rows[k][1], templates[7 * k][1])[1]) for k in range(40)}
