"""Rows of a query and of its SQL, in one comparable form."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "tolist"):
        return v.tolist()
    return v


def rows_of(df):
    names = sorted(df.columns)
    return sorted(repr([norm(r[c]) for c in names]) for r in df.collect()), names


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(names)
    at = [names.index(c) for c in order]
    return sorted(repr([norm(r[i]) for i in at]) for r in got.fetchall()), order
