"""Run registered queries next to their SQL and compare rows, column names and types."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


# DuckDB types under the name of the Spark type that holds them.
SAME_TYPE = {
    "VARCHAR": "string",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "DATE": "date",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same rows; otherwise what differs."""
    names = sorted(spark_df.columns)
    rel = con.sql(sql)
    types = {n: SAME_TYPE.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    if sorted(types) != names:
        return f"columns {names} != {sorted(types)}"
    off = {n: (t, types[n]) for n, t in spark_df.dtypes if t != types[n]}
    pick = ", ".join(f'"{n}"' for n in names)
    expected = Counter(con.execute(f"SELECT {pick} FROM ({sql})").fetchall())
    got = Counter(tuple(r) for r in spark_df.select(*[f"`{n}`" for n in names]).collect())
    if expected != got:
        extra, lacking = got - expected, expected - got
        return (
            f"{sum(extra.values())} extra, {sum(lacking.values())} lacking of {sum(expected.values())}; {names} "
            f"e.g. {sorted(extra, key=str)[:2]} / {sorted(lacking, key=str)[:2]}"
        )
    return f"types {off}" if off else None


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def operators(df) -> list[str]:
    """Physical operators, from the tree part of the plan."""
    return re.findall(r"[:+\-\s]*([A-Z]\w+)[^\n]*\(\d+\)", plan(df).split("\n\n")[0])


def main(sf_dir: str, wanted: list[str]) -> int:
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", os.environ.get("PARTS", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in wanted or queries:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                t1 = time.time()
                problem = difference(df, con, oracles[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note, problem = f"rows only: {len(df.collect())}", None
        except Exception as error:
            problem = note = f"ERROR {str(error)[:900]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - t0:6.2f}s  {note}", flush=True)
    print(f"{bad} problems", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
