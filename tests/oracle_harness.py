"""Run a registered query in Spark and its SQL in DuckDB; compare results.

Comparison: same column names (order-free), same row count and the same
multiset of rows after normalising values (NULL/NaN -> None, floats rounded
to 6 places, timestamps/dates to ISO text, Decimal -> float).
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, (_dt.datetime,)):
        return v.isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows_spark(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, rows


def _rows_duck(con, sql):
    cur = con.execute(sql)
    cols0 = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(cols0)), key=lambda i: cols0[i])
    cols = [cols0[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, rows


def _key(row):
    return tuple((x is None, str(type(x).__name__), str(x)) for x in row)


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    scols, srows = _rows_spark(fn(spark, sf_dir))
    t1 = time.time()
    out = {"query": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    dcols, drows = _rows_duck(con, sql)
    out["duck_rows"] = len(drows)
    if scols != dcols:
        out["status"] = "SCHEMA"
        out["detail"] = f"spark={scols} duck={dcols}"
        return out
    a = sorted(srows, key=_key)
    b = sorted(drows, key=_key)
    if a == b:
        out["status"] = "OK"
    else:
        out["status"] = "VALUES"
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out["detail"] = f"first diffs: {diff}" if diff else "row counts differ"
    return out


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from tidewater.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for n in (names or list(qs)):
        try:
            r = compare(spark, n, qs[n], sqls.get(n), sf_dir, con)
        except Exception as e:  # noqa: BLE001
            r = {"query": n, "status": "ERROR", "detail": repr(e)[:600]}
        if r["status"] not in ("OK", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"# {bad} not OK of {len(names or qs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
