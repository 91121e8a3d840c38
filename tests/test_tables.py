"""Sheets read in splits give the rows of the single-task reader."""

import csv
import random

import pytest

from assayer.sources import tabular


@pytest.mark.parametrize(("size", "seed"), [(2000, 1), (1500, 2)])
def test_splits_give_the_same_rows(spark, tmp_path, size, seed):
    rnd = random.Random(seed)
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w", encoding="utf-8-sig" if name == "a.csv" else "utf-8", newline="") as f:
            out = csv.writer(f, lineterminator="\r\n" if seed == 2 else "\n")
            out.writerow(["CID", "File", "Comment"])
            for k in range(120):
                parts = ["x", ",", '"', "\n", "é", "; ", "\n\n", "words of text"]
                out.writerow([k, f"{name}/{k}", "c" + "".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) + "c"])
                if k % 50 == 0:
                    f.write("\n" if seed != 2 else "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = tabular.read_table(spark, str(tmp_path))
        lines = tabular.records(spark, str(tmp_path)).select("file", "block").distinct().count()
        rows = sorted(tuple(r) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, encoding="utf-8-sig", newline="") as f:
            want += [tuple(r) for r in list(csv.reader(f))[1:] if r]
    assert got.columns == ["CID", "File", "Comment"] and rows == sorted(want)
    assert lines > 4


def test_one_cell_over_many_blocks_and_empty_tables(spark, tmp_path):
    long = "\n".join(f"line {k}, of one \"\"cell\"\"" for k in range(1500))
    (tmp_path / "x.csv").write_text(f'a,b\n1,"{long}"\n2,z\n')
    (tmp_path / "y.csv").write_text("a,b\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = {r["a"]: r["b"] for r in tabular.read_table(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"1": long.replace('""', '"'), "2": "z"}
