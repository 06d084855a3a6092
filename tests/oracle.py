"""Rows of a query against rows of its SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in table)


def differences(df, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    want = rows([c[0] for c in found.description], found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    return got[0] != want[0] and (got[0], want[0]), list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3], sum(want[1].values())
