"""Run registered queries beside their SQL and compare: python tools/check.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from saldo.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("f", round(v, 9) + 0.0)
    if isinstance(v, list):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return (type(v).__name__, v)


def rows(table):
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    return cols, Counter(tuple(norm(v) for v in r) for r in zip(*data))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    got = fn(spark, sf_dir).toArrow()
    t1 = time.time()
    if sql is None:
        return f"ROWS  {name}: {got.num_rows} rows {t1 - t0:.1f}s"
    want = con.sql(sql).to_arrow_table()
    gc, gr = rows(got)
    wc, wr = rows(want)
    if gc != wc:
        return f"FAIL  {name}: columns {gc} vs {wc}"
    if gr != wr:
        a, b = list((gr - wr).items())[:3], list((wr - gr).items())[:3]
        return f"FAIL  {name}: {got.num_rows} vs {want.num_rows} rows; {sum((gr - wr).values())} differ\n   cols  {gc}\n   spark {a}\n   sql   {b}"
    return f"ok    {name}: {got.num_rows} rows {t1 - t0:.1f}s"


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir, argv = argv[0], argv[1:]
    from saldo.catalog import load

    queries, sql = load()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            msg = compare(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            msg = f"ERROR {name}: {type(e).__name__} {str(e)[:900]}"
        bad += not msg.startswith(("ok", "ROWS"))
        print(msg, flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
