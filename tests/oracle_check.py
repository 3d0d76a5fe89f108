"""Run registered queries against their DuckDB twins.

    python tests/oracle_check.py [--sf 0.01] [--cut] [name or prefix ...]

`--cut` treats every input as large and cuts series into parts of 700 rows.
"""

import argparse
import os
import sys
import tempfile
import time
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from marketloom import session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if v != v:
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, dict):
        return repr({k: norm(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    return repr(v)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    ap.add_argument("--cut", action="store_true")
    args = ap.parse_args()
    if args.cut:
        from marketloom.operators import indicators, series
        series.Layout.__init__.__defaults__ = (("symbol",), ("date",), 90 * 86400, 700)
        indicators.WARM_UP = 60
    sf = f"/root/testdata/sf{args.sf}"
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = session.build("oracle", master="local[8]", shuffle_partitions=8, **{
        "spark.driver.memory": "8g", "spark.checkpoint.dir": f"{folder}/ck", "spark.local.dir": folder,
        "spark.sql.warehouse.dir": f"{folder}/wh", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    qs, sqls = entry.queries(), entry.oracle_sql()
    picked = [n for n in qs if not args.names or any(n.startswith(p) for p in args.names)]
    bad = []
    for n in picked:
        t0 = time.time()
        try:
            df = qs[n](spark, sf)
            cols = sorted(df.columns)
            rows = sorted([norm(r[c]) for c in cols] for r in df.collect())
            t1 = time.time() - t0
            if n not in sqls:
                print(f"rows  {n} {len(rows)} {t1:.1f}s", flush=True)
                continue
            t0 = time.time()
            rel = con.execute(sqls[n])
            names = [d[0] for d in rel.description]
            got = rel.fetchall()
            idx = [names.index(c) for c in sorted(names)]
            want = sorted([norm(r[i]) for i in idx] for r in got)
            t2 = time.time() - t0
            if cols != sorted(names):
                raise AssertionError(f"columns {cols} vs {sorted(names)}")
            if rows != want:
                a, b = [tuple(r) for r in rows], [tuple(r) for r in want]
                only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
                raise AssertionError(f"{len(rows)} vs {len(want)} rows; {len(only_a)}/{len(only_b)} differ\n  "
                                     f"cols {cols}\n  spark {only_a[:3]}\n  duck  {only_b[:3]}")
            print(f"ok    {n} {len(rows)} {t1:.1f}s duck {t2:.1f}s" + ("  EMPTY" if not rows else ""), flush=True)
        except Exception as exc:  # report and go on
            bad.append(n)
            print(f"FAIL  {n} {str(exc)[:1500]}", flush=True)
    print(f"{len(picked) - len(bad)}/{len(picked)} pass", "bad:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
