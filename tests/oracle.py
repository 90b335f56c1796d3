"""Spark-vs-DuckDB comparison used by the tests (mirrors the driver's gate):
same column names, same row count, same multiset of rows."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    return v


def spark_types(df):
    m = {"IntegerType": "int32", "LongType": "int64", "DoubleType": "float64", "StringType": "str",
         "TimestampNTZType": "ts", "TimestampType": "ts", "BooleanType": "bool", "DateType": "date",
         "ShortType": "int16", "ByteType": "int8", "FloatType": "float32"}
    out = {}
    for f in df.schema.fields:
        n = type(f.dataType).__name__
        out[f.name] = m.get(n, n.replace("Type", "").lower())
    return out


def duck_types(con, sql):
    m = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "str", "TIMESTAMP": "ts",
         "BOOLEAN": "bool", "DATE": "date", "SMALLINT": "int16", "TINYINT": "int8", "FLOAT": "float32",
         "HUGEINT": "int128"}
    rel = con.sql(sql)
    out = {}
    for n, t in zip(rel.columns, rel.types):
        t = str(t)
        if t.endswith("[]"):
            out[n] = "array"
        elif t.startswith("STRUCT"):
            out[n] = "struct"
        elif t.startswith("DECIMAL"):
            out[n] = "decimal"
        else:
            out[n] = m.get(t, t.lower())
    return out


def rows_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)


def compare(df, con, sql, check_types=True):
    if check_types:
        st, dt = spark_types(df), duck_types(con, sql)
        assert st == dt, f"types differ: spark={st} duck={dt}"
    sc, sr = rows_spark(df)
    dc, dr = rows_duck(con, sql)
    assert sc == dc, f"columns differ: spark={sc} duck={dc}"
    assert len(sr) == len(dr), f"row counts differ: spark={len(sr)} duck={len(dr)}"
    if sr != dr:
        diff_s = [r for r in sr if r not in set(dr)][:5]
        diff_d = [r for r in dr if r not in set(sr)][:5]
        raise AssertionError(f"values differ\nspark-only: {diff_s}\nduck-only: {diff_d}")
    return len(sr)
