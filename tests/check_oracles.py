"""Run queries next to their SQL checks: python tests/check_oracles.py [sf_dir] [name ...]"""

import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import __spark_entry__ as entry  # noqa: E402
from assayer import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    got_cols = sorted(df.columns)
    got = df.select(*got_cols).toPandas()
    if sql is None:
        return f"rows only, {len(got)}"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql).df()
    want = want[sorted(want.columns)]
    if got_cols != list(want.columns):
        return f"COLUMNS {got_cols} != {list(want.columns)}"

    def norm(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else repr(round(v, 9))
        return str(v)

    def rows(pdf):
        return sorted(tuple(norm(v) for v in r) for r in pdf.itertuples(index=False))

    a, b = rows(got), rows(want)
    types = [f"{c}:{got[c].dtype}/{want[c].dtype}" for c in got_cols if len(got) and got[c].dtype != want[c].dtype]
    note = f"  TYPES {types}" if types else ""
    if a == b:
        return f"ok {len(a)}{note}"
    sa, sb = set(a), set(b)
    only_a, only_b = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
    return f"DIFF spark={len(a)} duck={len(b)} cols={got_cols}\n   spark only {only_a}\n   duck only {only_b}{note}"


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if args and name not in args:
            continue
        t0 = time.time()
        try:
            result = compare(spark, sf_dir, name, query, oracles.get(name))
        except Exception as e:  # report and go on
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        flag = result.startswith(("DIFF", "ERROR", "COLUMNS"))
        bad += flag
        print(f"{'!!' if flag else '  '} {name:28s} {time.time() - t0:6.1f}s {result}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
