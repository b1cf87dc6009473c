"""Run a query in Spark and its oracle in DuckDB and compare rows exactly
(column names, type families, row count, multiset of value tuples)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _family(t: str) -> str:
    t = t.lower()
    if t.startswith("decimal"):
        return t.replace(" ", "")
    for fam, keys in [("int", ("integer", "int", "int32")), ("long", ("bigint", "long", "int64")),
                      ("double", ("double", "float64")), ("string", ("varchar", "string")),
                      ("ts", ("timestamp", "timestamp_ntz")), ("bool", ("boolean",)),
                      ("date", ("date",))]:
        if t in keys:
            return fam
    return t


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return str(v)


def compare(spark, sf_dir: str, name: str, fn, sql: str, con=None) -> dict:
    con = con or duck(sf_dir)
    sdf = fn(spark, sf_dir)
    s_types = {f.name: _family(f.dataType.simpleString()) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = {c: _family(str(t)) for c, t in zip(d_cols, rel.types)}
    d_rows = rel.fetchall()
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows)}
    if sorted(s_types) != sorted(d_types):
        out["error"] = f"columns differ: {sorted(s_types)} vs {sorted(d_types)}"
        return out
    bad_types = {c: (s_types[c], d_types[c]) for c in s_types if s_types[c] != d_types[c]}
    out["type_mismatch"] = bad_types
    cols = sorted(s_types)
    s_idx = [list(sdf.columns).index(c) for c in cols]
    d_idx = [list(d_cols).index(c) for c in cols]
    sk = sorted((tuple(_norm(r[i]) for i in s_idx) for r in s_rows), key=repr)
    dk = sorted((tuple(_norm(r[i]) for i in d_idx) for r in d_rows), key=repr)
    out["match"] = sk == dk and not bad_types
    if sk != dk:
        sset, dset = set(sk), set(dk)
        out["only_spark"] = [dict(zip(cols, r)) for r in list(sset - dset)[:3]]
        out["only_oracle"] = [dict(zip(cols, r)) for r in list(dset - sset)[:3]]
    return out
