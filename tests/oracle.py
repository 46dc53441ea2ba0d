"""Compares registered queries with their SQL: python tests/oracle.py DIR NAME..."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def mismatch(spark, folder: str, name: str) -> str:
    """What differs between a query and its SQL; empty if nothing does."""
    import duckdb
    import pandas as pd

    import __spark_entry__ as entry

    got = entry.queries()[name](spark, folder).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ""
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    columns = sorted(got.columns)
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    try:
        pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)
    except AssertionError as e:
        return str(e)
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for query in sys.argv[2:]:
        start = time.time()
        try:
            found = mismatch(session, sys.argv[1], query) or "equal"
        except Exception as e:
            found = repr(e)[:600]
        print(query, round(time.time() - start, 1), found, flush=True)
