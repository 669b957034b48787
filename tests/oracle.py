"""Compare a Spark query with its SQL in DuckDB."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v if v is None or isinstance(v, (int, bool, str)) else str(v)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows), [names[i] for i in order]


def assert_same(df, con, sql):
    got, names = _rows([tuple(r) for r in df.collect()], df.columns)
    found = con.sql(sql)
    want, columns = _rows(found.fetchall(), [c[0] for c in found.description])
    assert names == columns
    assert got == want
