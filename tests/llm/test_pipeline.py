"""The pipeline: its stages, one after the other, on a small table with planted cases."""

import random

import corpus_pipeline
from assayer.llm import queries

PASSAGE = "seven grey herons stand along the quiet river bank while the evening light slowly fades over the distant hills"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(900)}" for _ in range(n))


def write(spark, where):
    line = "A line of some length that many documents repeat word for word"
    rows = [(i, prose(80, i) + (f"\n{line}" if i % 5 == 0 else "")) for i in range(100)]
    rows += [(200, rows[3][1]), (201, rows[3][1] + " end"), (202, prose(20, 5000) + " " + PASSAGE), (203, None), (204, "")]
    rows += [(300 + i, prose(60, 600 + i) + " idiot moron scum trash") for i in range(30)]
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(80)] + [(300 + i, 1, 1) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")


def test_planted_cases(spark, tmp_path):
    where = str(tmp_path / "t")
    write(spark, where)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, where)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = {*range(100), 200, 201, 202, 203, 204}
    assert kept[0] == everything and kept[1] == everything
    assert kept[2] == everything - {200, 201} and kept[3] == kept[2] - {202}
    lines = spark.read.parquet(str(tmp_path / "line_dedup"))
    assert lines.where("contains(text, 'A line of some length')").select("doc_id").collect()[0].doc_id == 95
    assert lines.where("n_chars <> length(text)").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, where).collect()} == kept[4]


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
