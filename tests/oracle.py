"""Compare a registered Spark query with its SQL twin, by value and by column type."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in v.items()) + "}"
    return repr(v)


FAMILY = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, con, sf_dir, run, sql) -> list[str]:
    """Differences, empty when equal."""
    df = run(spark, sf_dir)
    rows = df.collect()
    rel = con.sql(sql)
    theirs = rel.fetchall()
    problems = []
    ours_cols, their_cols = sorted(df.columns), sorted(rel.columns)
    if ours_cols != their_cols:
        return [f"columns {ours_cols} != {their_cols}"]
    types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema:
        want = FAMILY.get(f.dataType.simpleString(), f.dataType.simpleString())
        if want != types[f.name]:
            problems.append(f"type of {f.name}: {want} != {types[f.name]}")
    order = {c: i for i, c in enumerate(rel.columns)}
    a = sorted("|".join(plain(r[c]) for c in ours_cols) for r in rows)
    b = sorted("|".join(plain(r[order[c]]) for c in ours_cols) for r in theirs)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"values differ: {len(only_a)}/{len(only_b)}\n   spark {only_a[:2]}\n   sql   {only_b[:2]}")
    if not a:
        problems.append("no rows")
    return [p[:1500] for p in problems]


def main(argv):
    sys.path.insert(0, ".")
    import registry
    from mediashelf.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    modules = [a for a in argv if not a.startswith("-")]
    for m in modules or ["library", "people", "ingest", "retrieval", "scalars", "documents", "understanding", "streams"]:
        __import__(f"registry.{m}")
    only = [a[2:] for a in argv if a.startswith("--")]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for key, run in registry.QUERIES.items():
        if only and key not in only:
            continue
        start = time.time()
        try:
            if key in registry.ORACLES:
                problems = compare(spark, con, sf_dir, run, registry.ORACLES[key])
                n = ""
            else:
                n = len(run(spark, sf_dir).collect())
                problems = [] if n else ["no rows"]
        except Exception as exc:  # noqa: BLE001 - report every query
            problems, n = [f"{type(exc).__name__}: {str(exc)[:1200]}"], ""
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {key:26s} {time.time() - start:5.1f}s {n}", *problems, sep="\n   " if problems else " ", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
