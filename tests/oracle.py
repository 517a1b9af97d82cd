"""Compare registered queries with their SQL twins: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _sortable(row):
    return tuple((v is None, str(type(v)), "" if v is None else v) for v in row)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cols = sorted(df.columns)
    spark_rows = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_sortable)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    wanted = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if wanted.get(kind, kind) != kinds[f.name]:
            return f"type of {f.name}: {kind} vs {kinds[f.name]}"
    at = [names.index(c) for c in cols]
    duck_rows = sorted((tuple(_norm(r[i]) for i in at) for r in res.fetchall()), key=_sortable)
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows vs {len(duck_rows)}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            return f"{cols}: {str(a)[:600]} vs {str(b)[:600]}"
    if not spark_rows:
        return "no rows"
    return None


def main() -> int:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    from tokengrove import build_session
    from tokengrove.catalog import load

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, oracles = load()
    names = sys.argv[2:] or list(queries)
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                verdict = compare(df, con, oracles[name])
            else:
                verdict = f"ROWS ONLY {df.count()}"
                print(f"{time.time() - start:6.2f}s  {name}: {verdict}", flush=True)
                continue
        except Exception as e:  # report and go on
            verdict = f"{type(e).__name__}: {str(e)[:1500]}"
        if verdict:
            bad += 1
        print(f"{time.time() - start:6.2f}s  {name}: {verdict or 'ok'}", flush=True)
    print(f"{len(names) - bad} good, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
