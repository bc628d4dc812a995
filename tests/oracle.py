"""Side-by-side comparison of a Spark result with DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def compare(spark_df, con, sql):
    got = cells([tuple(r) for r in spark_df.collect()], spark_df.columns)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = cells(cur.fetchall(), names)
    assert sorted(names) == sorted(spark_df.columns), (sorted(names), sorted(spark_df.columns))
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want, strict=True):
        assert g == w, f"spark {g[:600]}\nduckdb {w[:600]}"
