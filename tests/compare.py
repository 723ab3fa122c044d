"""Side-by-side runs of a registered query and its SQL on the same files."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"d{v.normalize():f}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def kind(t: str) -> str:
    t = t.lower()
    return {"long": "bigint", "int": "integer", "string": "varchar", "bool": "boolean", "timestamp_ntz": "timestamp"}.get(t, t)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, f, sql: str, sf_dir: str) -> str:
    """Empty when both agree, else what differs."""
    df = f(spark, sf_dir)
    rel = con.sql(sql)
    names, theirs = sorted(df.columns), sorted(rel.columns)
    if names != theirs:
        return f"columns {names} and {theirs}"
    ours_t = {c: kind(t) for c, t in df.dtypes}
    theirs_t = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types, strict=True)}
    odd = {c: (ours_t[c], theirs_t[c]) for c in names if ours_t[c] != theirs_t[c] and not ours_t[c].startswith(("array", "struct", "decimal"))}
    if odd:
        return f"types {odd}"
    a = sorted("|".join(plain(r[c]) for c in names) for r in df.collect())
    order = [rel.columns.index(c) for c in names]
    b = sorted("|".join(plain(r[k]) for k in order) for r in rel.fetchall())
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; ours {only[0]}; theirs {only[1]}"
    return ""
