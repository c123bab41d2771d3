"""Compare a query with its SQL on the small tables."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.6f}"
        return str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


def compare(spark, fn, sql, sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    want = canonical(con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM rel").fetchall())
    df = fn(spark, sf)
    assert sorted(df.columns) == names
    have = canonical([tuple(r) for r in df.select(*names).collect()])
    assert len(have) == len(want)
    assert have == want
    return len(have)
