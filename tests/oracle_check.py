"""Compare registered queries with their DuckDB oracle SQL.

Same criteria as the driver's gate: row count, column names (sorted) and an
order-insensitive hash of the values.  Run as a script:

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from jobtext.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def table_hash(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    c = Counter()
    for r in rows:
        c[repr(tuple(norm(r[i]) for i in order))] += 1
    h = hashlib.sha256()
    for k in sorted(c):
        h.update(f"{k}\x00{c[k]}\n".encode())
    return h.hexdigest(), c


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name, sf_dir, con=None, verbose=True):
    from jobtext.plans import ORACLE, QUERIES

    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if name not in ORACLE:
        return {"name": name, "rows": len(s_rows), "oracle": False, "ok": None, "sec": round(t1 - t0, 2)}
    rel = con.sql(ORACLE[name])
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "sec": round(t1 - t0, 2)}
    res["cols_ok"] = sorted(s_cols) == sorted(d_cols)
    hs, cs = table_hash(s_cols, s_rows)
    hd, cd = table_hash(d_cols, d_rows)
    res["ok"] = res["cols_ok"] and len(s_rows) == len(d_rows) and hs == hd
    if verbose and not res["ok"]:
        print(name, "spark cols", sorted(s_cols), "\n   duck cols", sorted(d_cols))
        only_s = list((cs - cd).items())[:3]
        only_d = list((cd - cs).items())[:3]
        print("  only spark:", [str(x)[:600] for x in only_s])
        print("  only duck :", [str(x)[:600] for x in only_d])
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from jobtext.plans import QUERIES
    from jobtext.session import build_session

    names = argv[2:] or sorted(QUERIES)
    spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "error": str(e)[:800]}
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
