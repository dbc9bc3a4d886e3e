"""Compare a DataFrame with DuckDB's answer: names, number of rows, and values without order."""

import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connection(sf_dir: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(x):
    if hasattr(x, "isoformat"):
        x = getattr(x, "replace", lambda **_: x)(tzinfo=None) if hasattr(x, "hour") else x
        return x.isoformat()
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x


def check(df, sql: str, con) -> None:
    names = sorted(df.columns)
    got = sorted([tuple(norm(r[c]) for c in names) for r in df.collect()], key=repr)
    found = con.execute(sql)
    have = [d[0] for d in found.description]
    assert sorted(have) == names, (sorted(have), names)
    at = [have.index(c) for c in names]
    want = sorted([tuple(norm(r[i]) for i in at) for r in found.fetchall()], key=repr)
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
