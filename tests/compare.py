"""Runs a query and its DuckDB SQL over the same tables and compares the rows as multisets."""

import glob
import os

import duckdb


def compare(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{at}'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in df.columns]
    want = [tuple(r[i] for i in place) for r in done.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return len(got)
