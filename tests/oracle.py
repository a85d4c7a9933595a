"""Compare queries with their SQL in DuckDB, as multisets of rows."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return str(x)[:19] if hasattr(x, "isoformat") else x


def differences(spark_df, con, sql):
    rel = con.sql(sql)
    if sorted(spark_df.columns) != sorted(rel.columns):
        return f"columns {sorted(spark_df.columns)} {sorted(rel.columns)}"
    names = sorted(spark_df.columns)
    a = Counter(tuple(cell(r[n]) for n in names) for r in spark_df.collect())
    at = [rel.columns.index(n) for n in names]
    b = Counter(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    if a != b:
        return f"rows {sum(a.values())} {sum(b.values())}; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
    return ""
