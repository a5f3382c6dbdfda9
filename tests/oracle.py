"""Compare registered queries with their SQL on DuckDB: python -m tests.oracle SF_DIR [QUERY...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        source = p if p.is_file() else p / "*.parquet"
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """What the two results don't have in common; empty if they agree."""
    found = con.execute(sql)
    theirs_columns = [d[0] for d in found.description]
    if sorted(theirs_columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(theirs_columns)}"]
    theirs, ours = rows_of(theirs_columns, found.fetchall()), rows_of(df.columns, df.collect())
    if ours == theirs:
        return []
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    return [f"{len(ours)} rows and {len(theirs)}, {len(a)} and {len(b)} without a partner", *(f"spark {x[:300]}" for x in sorted(a)[:3]), *(f"sql   {x[:300]}" for x in sorted(b)[:3])]


def main(sf_dir: str, *names: str) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle, bad = connect(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        t = time.time()
        try:
            diff = differences(queries[name](spark, sf_dir), con, oracle[name]) if name in oracle else []
            count = "" if name in oracle else f" {len(queries[name](spark, sf_dir).collect())} rows, no SQL"
        except Exception as e:  # every query gets its turn
            diff, count = [str(e)[:900]], ""
        bad += bool(diff)
        print(f"{name}: {'DIFFERS' if diff else 'ok'}{count} {time.time() - t:.1f} s", *diff, sep="\n    ", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
