"""Compare registered queries with their SQL: ``python tests/verify.py sf0.01 [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings bed_lines bed_files fragments cuts peaks tracks chrom_sizes blacklist pack_sizes mix_targets".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    seen = []
    for row in df.astype(object).itertuples(index=False):
        seen.append(tuple(None if x is None or x is pd.NA or x is pd.NaT or x != x else round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x for x in row))
    return sorted(seen, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, folder: str, name: str) -> str:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    began = time.time()
    frame = entry.queries()[name](spark, folder)
    got = frame.toPandas()
    took = time.time() - began
    if name not in entry.oracle_sql():
        return f"rows only: {len(got)} rows, {took:.1f} s"
    want = con.execute(entry.oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        return f"DIFFER {len(a)} {len(b)} rows, e.g. {[x for x in a if x not in set(b)][:3]} {[x for x in b if x not in set(a)][:3]}"
    return f"equal: {len(a)} rows, {took:.1f} s"


if __name__ == "__main__":
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or entry.queries():
        try:
            print(name, compare(spark, f"/root/testdata/{sys.argv[1]}", name), flush=True)
        except Exception as e:
            print(name, "ERROR", str(e)[:800], flush=True)
