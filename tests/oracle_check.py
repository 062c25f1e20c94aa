"""Compare registered queries with their SQL on DuckDB: python tests/oracle_check.py [sf] [name ...]"""
from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def compare(query, spark, con, sf: str) -> tuple[bool, str]:
    df = query.run(spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(canon(r[n]) for n in names) for r in df.collect()), key=repr)
    sql = query.oracle()
    if sql is None:
        return bool(got), f"rows only: {len(got)}"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    at = {n: cols.index(n) for n in names}
    want = sorted((tuple(canon(r[at[n]]) for n in names) for r in cur.fetchall()), key=repr)
    if got == want:
        return True, f"{len(got)} rows"
    from collections import Counter
    a, b = Counter(got) - Counter(want), Counter(want) - Counter(got)
    return False, (f"spark {len(got)} sql {len(want)} differing {sum(a.values())}\n   names {names}\n   spark "
                   f"{list(a)[:3]}\n   sql   {list(b)[:3]}")


if __name__ == "__main__":
    from tests.conftest import make_session
    from pitval.plans import all_queries
    args = sys.argv[1:]
    sf = f"/root/testdata/sf{args[0] if args else '0.01'}"
    todo = all_queries()
    picked = [n for n in todo if not args[1:] or any(n == a or n.startswith(a) for a in args[1:])]
    spark, con = make_session(), duck(sf)
    bad = []
    for name in picked:
        t0 = time.time()
        try:
            ok, note = compare(todo[name], spark, con, sf)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t0:.1f}s {note}", flush=True)
    print(f"{len(picked) - len(bad)}/{len(picked)} agree; failing: {bad}")
