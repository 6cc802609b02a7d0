"""Compare a Spark result with the SQL result of an independent engine, regardless of row order."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [_value(x) for x in v]
    if isinstance(v, dict):
        return {k: _value(x) for k, x in v.items()}
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_value(r[i]) for i in order]) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    want = rel.fetchall()
    t2 = time.time()
    report = {"rows": len(got), "want": len(want), "spark": round(t1 - t0, 2), "sql": round(t2 - t1, 2), "ok": True}
    if sorted(df.columns) != sorted(rel.columns):
        report.update(ok=False, why=f"columns {sorted(df.columns)} vs {sorted(rel.columns)}")
        return report
    a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        report.update(ok=False, why=f"{len(only_a)} only spark, {len(only_b)} only sql", a=only_a[:2], b=only_b[:2])
    return report


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from lodestone.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        try:
            if name in sqls:
                r = compare(spark, con, queries[name], sqls[name], sf_dir)
            else:
                t0 = time.time()
                r = {"ok": True, "rows": len(queries[name](spark, sf_dir).collect()), "spark": round(time.time() - t0, 2), "sql": None}
        except Exception as e:
            r = {"ok": False, "why": f"{type(e).__name__}: {str(e)[:700]}"}
        print("OK  " if r.pop("ok") else "FAIL", name, {k: (v if not isinstance(v, list) else [x[:500] for x in v]) for k, v in r.items()}, flush=True)
