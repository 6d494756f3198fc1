"""Compare registered Spark queries with their DuckDB SQL on the same parquet files.

Column-name-sorted, exact value comparison (floats compared by their exact binary
value).  Rows are compared as sets of rows, and, where the SQL ends in an ORDER BY of its
own, also in their order.  Usage::

    python -m tests.oracle_harness /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return ("f", "nan") if math.isnan(v) else ("f", v)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, decimal.Decimal):
        return ("f", float(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    if hasattr(v, "item"):
        return _canon(v.item())
    return ("s", str(v))


def _listed(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [tuple(_canon(r[i]) for i in order) for r in rows]


def _rows(cols, rows):
    cols, out = _listed(cols, rows)
    return cols, sorted(out, key=repr)


def is_ordered(sql: str) -> bool:
    """Whether a statement's own ORDER BY, outside all brackets, orders its rows."""
    depth, outside = 0, []
    for c in sql:
        depth += (c == "(") - (c == ")")
        if depth == 0:
            outside.append(c)
    return "ORDER BY" in "".join(outside)


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    return cols, rel.fetchall()


def compare(spark, sf_dir: str, keys=None, con=None, verbose=True):
    sys.path.insert(0, ".")
    import __spark_entry__ as se
    qs, sqls = se.queries(), se.oracle_sql()
    con = con or duck(sf_dir)
    results = {}
    for key in keys or list(qs):
        t0 = time.time()
        try:
            sc, sl = _listed(*spark_rows(qs[key](spark, sf_dir)))
            sr = sorted(sl, key=repr)
        except Exception as e:  # noqa: BLE001
            results[key] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(key, results[key], flush=True)
            continue
        t1 = time.time()
        if key not in sqls:
            results[key] = f"rows-only ({len(sr)} rows)"
        else:
            try:
                dc, dl = _listed(*duck_rows(con, sqls[key]))
                dr = sorted(dl, key=repr)
            except Exception as e:  # noqa: BLE001
                results[key] = f"DUCK ERROR {str(e)[:300]}"
                if verbose:
                    print(key, results[key], flush=True)
                continue
            if sc != dc:
                results[key] = f"COLUMNS differ spark={sc} duck={dc}"
            elif len(sr) != len(dr):
                results[key] = f"ROWCOUNT spark={len(sr)} duck={len(dr)}"
            elif sr != dr:
                bad = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
                results[key] = f"VALUES differ, e.g. {bad}"
            elif is_ordered(sqls[key]) and sl != dl:
                at = next(i for i, (a, b) in enumerate(zip(sl, dl)) if a != b)
                results[key] = f"ORDER differs from row {at}: {sl[at]} {dl[at]}"
            else:
                results[key] = f"ok ({len(sr)} rows{', in order' if is_ordered(sqls[key]) else ''})"
        if verbose:
            print(f"{key}: {results[key]}  [{t1 - t0:.2f}s]", flush=True)
    return results


if __name__ == "__main__":
    from stockroom.session import get_session
    spark = get_session("local[8]", 8)
    res = compare(spark, sys.argv[1], sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if not (v.startswith("ok") or v.startswith("rows-only"))}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    sys.exit(1 if bad else 0)
