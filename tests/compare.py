"""Run named queries in Spark and their SQL twins in DuckDB, and compare the rows.

python tests/compare.py [sf] [name or prefix ...]
"""

import datetime as dt
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()  # fmt: skip


def plain(value):
    if isinstance(value, Decimal):
        return f"{value:f}"
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(repr([plain(row[i]) for i in order]) for row in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(named, spark, con, sf_dir):
    """None when both engines agree, else what differs; and the number of rows."""
    got = named.build(spark, sf_dir)
    mine = rows_of(got.columns, got.collect())
    if named.sql is None:
        return None, sum(mine.values())
    result = con.execute(named.sql)
    names = [c[0] for c in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} vs {sorted(names)}", sum(mine.values())
    if mine != theirs:
        only, other = mine - theirs, theirs - mine
        return (
            f"{sum(only.values())} rows only in Spark, {sum(other.values())} only in SQL\n"
            f"    spark {list(only)[:2]}\n    sql   {list(other)[:2]}"
        ), sum(mine.values())
    return None, sum(mine.values())


def main():
    from billmill.plans.catalog import QUERIES
    from billmill.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(cores=8, partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name, named in QUERIES.items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            problem, count = difference(named, spark, con, sf_dir)
        except Exception as exc:  # keep going, list it
            problem, count = f"{type(exc).__name__}: {str(exc)[:600]}", -1
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if named.sql else " (rows only)"
        print(f"{mark} {name} rows={count} {time.time() - start:.1f}s{kind}", flush=True)
        if problem:
            print("    " + problem, flush=True)
    print(f"{bad} differences", flush=True)


if __name__ == "__main__":
    main()
