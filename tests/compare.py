"""Run registered queries and their SQL side by side: python -m tests.compare [names...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, int):
        return repr(int(v))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), "rows only" if got else "EMPTY"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    types = {n: str(d[1]) for n, d in zip(names, res.description)}
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return len(got), f"ROWS {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return len(got), f"VALUES {len(bad)} differ, e.g. {bad[0]}"
    if any(t == "HUGEINT" for t in types.values()):
        return len(got), f"HUGEINT {types}"
    return len(got), "ok"


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from aligngrid.session import make_session

    spark = make_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    con = connect(sf)
    q, o = entry.queries(), entry.oracle_sql()
    want = [n for a in sys.argv[1:] for n in q if n.startswith(a)] or list(q)
    bad = 0
    for n in want:
        t = time.time()
        try:
            rows, msg = compare(spark, con, q[n], o.get(n), sf)
        except Exception as e:  # report and go on
            rows, msg = -1, f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        ok = msg in ("ok", "rows only")
        bad += not ok
        print(f"{'  ' if ok else '! '}{n:24s} {rows:8d} {time.time() - t:6.1f}s {msg}", flush=True)
    print("bad:", bad, "of", len(want))


if __name__ == "__main__":
    main()
