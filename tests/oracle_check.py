"""Run registered queries against their SQL oracles (DuckDB) and report.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


STRICT = bool(int(__import__("os").environ.get("ORACLE_STRICT", "0")))


def norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NaT:
            return None
    except Exception:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if STRICT else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        return v if STRICT else round(v, 6)
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                 "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float",
                 "SMALLINT": "smallint", "HUGEINT": "decimal", "TIMESTAMP WITH TIME ZONE": "timestamp"}


def type_diffs(sdf, res) -> list[str]:
    s_types = dict(sdf.dtypes)
    out = []
    for c, t in zip(res.columns, res.types):
        want = DUCK_TO_SPARK.get(str(t), str(t).lower())
        if c in s_types and s_types[c] != want:
            out.append(f"{c}: spark={s_types[c]} oracle={t}")
    return out


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t
    if sql is None:
        return f"{name}: rows-only {len(s_rows)} ({ts:.1f}s)", True
    res = con.sql(sql)
    o_cols = res.columns
    o_rows = res.fetchall()
    if sorted(s_cols) != sorted(o_cols):
        return f"{name}: COLUMNS differ spark={sorted(s_cols)} oracle={sorted(o_cols)}", False
    diffs = type_diffs(sdf, res)
    if diffs:
        return f"{name}: TYPES differ {diffs}", False
    a, b = rows_of(s_cols, s_rows), rows_of(o_cols, o_rows)
    if len(a) != len(b):
        return f"{name}: ROWCOUNT spark={len(a)} oracle={len(b)}", False
    for x, y in zip(a, b):
        if x != y:
            return f"{name}: VALUES differ\n  spark ={x}\n  oracle={y}", False
    return f"{name}: OK {len(a)} rows ({ts:.1f}s)", True


def main():
    import duckdb
    from gridlens.session import build_session
    import __spark_entry__ as E

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            msg, ok = compare(spark, con, name, qs[name], os_.get(name), sf_dir)
        except Exception as e:  # report and go on
            msg, ok = f"{name}: ERROR {type(e).__name__}: {str(e)[:600]}", False
        bad += not ok
        print(msg, flush=True)
    print(f"{len(names or qs) - bad}/{len(names or qs)} ok")


if __name__ == "__main__":
    main()
