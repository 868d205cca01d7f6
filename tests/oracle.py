"""Holds every registered query with SQL against DuckDB: python -m tests.oracle FOLDER [NAME...]."""

import math
import sys
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(rows):
    key = lambda v: (v is None, str(v))
    fixed = [tuple(round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows]
    return sorted(fixed, key=lambda r: tuple(map(key, r)))


def difference(spark, c, folder, query, sql):
    """None if both give the same columns and rows."""
    df = query(spark, folder)
    names = sorted(df.columns)
    mine = plain(tuple(r[n] for n in names) for r in df.collect())
    cur = c.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    theirs = plain(tuple(r[theirs_names.index(n)] for n in names) for r in cur.fetchall())
    if mine != theirs:
        other = [x for x in zip(mine, theirs) if x[0] != x[1]][:2]  # noqa: B905
        return f"{len(mine)} and {len(theirs)} rows; {other}"
    return None


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    folder, names = sys.argv[1], sys.argv[2:]
    c, qs = database(folder), e.queries()
    for name, sql in e.oracle_sql().items():
        if not names or name in names:
            at = time.time()
            try:
                said = difference(spark, c, folder, qs[name], sql) or "same"
            except Exception as x:
                said = f"FAILED {type(x).__name__}: {str(x)[:300]}"
            print(f"{name}: {said} ({time.time() - at:.1f} s)", flush=True)
