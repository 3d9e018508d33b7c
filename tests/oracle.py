"""Side-by-side runs of a query in Spark and its SQL in DuckDB."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


def key(row):
    return tuple((x is not None, "" if x is None else (round(x, 9) if isinstance(x, float) and not math.isnan(x) else x).__repr__()) for x in row)


def both(spark, sf_dir, run, sql):
    """Sorted rows of both engines, columns by name."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*(f"`{n}`" for n in names)).collect()]
    con = connect(sf_dir)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    rows = rel.fetchall()
    assert sorted(cols) == names, (sorted(cols), names)
    order = [cols.index(n) for n in names]
    theirs = [tuple(r[k] for k in order) for r in rows]
    norm = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    return sorted(ours, key=key), sorted((tuple(map(norm, r)) for r in theirs), key=key)
