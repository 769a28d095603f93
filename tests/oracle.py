"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    b = rows(names, cur.fetchall())
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]), [x for x in a[1] if x not in set(b[1])][:2], [x for x in b[1] if x not in set(a[1])][:2])
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    assert not bad, (len(bad), bad[:2])
    return len(a[1])
