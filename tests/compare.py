"""Strict comparison of a Spark result with the result of its SQL equivalent."""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pd.api.types.is_datetime64_any_dtype(pdf[c]):
            pdf[c] = pdf[c].astype("datetime64[us]")
    text = pdf.astype(object).where(pdf.notna(), None).map(
        lambda v: "null" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    )
    return sorted(map(tuple, text.itertuples(index=False)))


def differences(spark_pdf, duck_pdf):
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} / {sorted(duck_pdf.columns)}"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    kinds = lambda p: [p[c].dtype.kind.replace("O", "s").replace("u", "i") for c in sorted(p.columns)]
    if len(a) and kinds(spark_pdf) != kinds(duck_pdf):
        return f"types {spark_pdf.dtypes.to_dict()} / {duck_pdf.dtypes.to_dict()}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        try:
            start = time.time()
            got = entry.queries()[name](spark, sf_dir).toPandas()
            middle = time.time()
            want = con.execute(entry.oracle_sql()[name]).df()
            note = differences(got, want) or f"ok, {len(got)} rows"
            print(f"{name}: {note} (spark {middle - start:.1f}s, sql {time.time() - middle:.1f}s)", flush=True)
        except Exception as error:
            print(f"{name}: FAILED {type(error).__name__} {str(error)[:1500]}", flush=True)
