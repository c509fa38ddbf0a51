"""Compare a registered query with its oracle SQL on the given tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, float):
        return ("f", value + 0.0)
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return ("t", str(value))
    return ("s", str(value))


def _loose(row):
    return tuple(("f", round(c[1], 5)) if c and c[0] == "f" else c for c in row)


def compare(df, con, sql: str) -> str:
    names = sorted(df.columns)
    ours = Counter(tuple(_cell(r[n]) for n in names) for r in df.select(*names).collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"COLUMNS spark={names} oracle={sorted(cols)}"
    order = [cols.index(n) for n in names]
    theirs = Counter(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())
    n = sum(theirs.values())
    if ours == theirs:
        return f"EXACT {n}" if n else "EMPTY"
    lo, lt = Counter(), Counter()
    for r, k in ours.items():
        lo[_loose(r)] += k
    for r, k in theirs.items():
        lt[_loose(r)] += k
    if lo == lt:
        a = next(iter(ours - theirs))
        return f"CLOSE {n} ours={a}"
    a, b = ours - theirs, theirs - ours
    return f"DIFF rows {sum(ours.values())} vs {n}; columns {names}; ours only {list(a.items())[:3]}; oracle only {list(b.items())[:3]}"


def main(argv):
    from framegate.plans.registry import oracles, queries
    from framegate.runtime import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = queries(), oracles()
    picked = [q for q in qs if not argv or any(q.startswith(a) for a in argv)]
    con = connect(sf_dir)
    bad = []
    for name in picked:
        start = time.time()
        try:
            df = qs[name](spark, sf_dir)
            verdict = compare(df, con, sqls[name]) if name in sqls else f"ROWS {df.count()}"
        except Exception as exc:  # noqa: BLE001  (report and go on)
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        if not verdict.startswith(("EXACT", "ROWS")):
            bad.append(name)
        print(f"{name:36s} {time.time() - start:6.2f}s {' '.join(verdict[:900].split())}", flush=True)
    print(f"{len(picked) - len(bad)}/{len(picked)} good; bad: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
