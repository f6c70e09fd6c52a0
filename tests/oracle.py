"""DuckDB over the same files, and rows in a form that both sides share."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(frame):
    def form(v):
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if v is None or v != v or str(v) == "NaT":
            return "None"
        return f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(form(v) for v in r) for r in frame[columns].itertuples(index=False))


def duck(sql, folder=DATA):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return c.execute(sql).df()
