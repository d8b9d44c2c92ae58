"""Runs registered queries against their SQL on the given tables and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return "NULL"
        if isinstance(v, float):
            if math.isnan(v):
                return "NULL"
            return repr(float(v)) if v != int(v) or abs(v) > 1e15 else str(int(v))
        if hasattr(v, "item"):
            return cell(v.item())
        return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def compare(spark, name, fn, sql, sf_dir, con) -> str:
    df = fn(spark, sf_dir)
    got = df.toPandas()
    if sql is None:
        return f"rows-only {len(got)}" if len(got) else "EMPTY (no SQL)"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return f"ok {len(a)}" if a else "ok 0"
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:3]
    only_b = [r for r in b if r not in in_a][:3]
    return f"DIFF {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}"


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from slotwise.session import local_session

    sf_dir, wanted = argv[0], argv[1:]
    spark = local_session(cores="8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    bad = 0
    for name in names:
        begin = time.time()
        try:
            result = compare(spark, name, queries[name], oracles.get(name), sf_dir, con)
        except Exception as e:  # report and go on
            result = "ERROR " + str(e)[:700].replace("\n", " ")
        failed = not result.startswith(("ok", "rows-only"))
        bad += failed
        print(f"{'!!' if failed else '  '} {name:32s} {time.time() - begin:6.2f}s {result}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
