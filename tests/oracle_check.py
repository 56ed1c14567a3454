"""Compare every registered query with its checking SQL: ``python tests/oracle_check.py [sf] [name ...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if hasattr(value, "item") and not isinstance(value, str):
        try:
            value = value.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6)
    return value if isinstance(value, int | float) else str(value)


def rows(pdf):
    cols = sorted(pdf.columns)
    data = [[None if v is None or v is getattr(v, "NaT", 0) or str(v) == "NaT" else canon(v) for v in r] for r in pdf[cols].astype(object).values.tolist()]
    return cols, sorted(data, key=lambda r: [str(x) for x in r])


def compare(spark, con, name, run, sql, sf_dir):
    t0 = time.time()
    got = run(spark, sf_dir).toPandas()
    took = time.time() - t0
    if sql is None:
        return len(got), took, None
    t0 = time.time()
    want = con.execute(sql).df()
    oracle = time.time() - t0
    gc, g = rows(got)
    wc, w = rows(want)
    if gc != wc:
        return len(got), took, f"columns {gc} != {wc}"
    bad = [(n, got[n].dtype, want[n].dtype) for n in gc if got[n].dtype.kind != want[n].dtype.kind]
    if len(g) != len(w):
        extra = [r for r in g if r not in w][:2], [r for r in w if r not in g][:2]
        return len(got), took, f"rows {len(g)} != {len(w)} {extra}"
    for a, b in zip(g, w):
        if a != b:
            return len(got), took, f"{gc}\n   {a}\n   {b}"
    return len(got), took, ("kinds " + str(bad)) if bad and len(g) else ("slow oracle %.1f" % oracle if oracle > 20 else "")


def main():
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            n, took, problem = compare(spark, con, name, run, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            n, took, problem = -1, 0, f"{type(e).__name__}: {str(e)[:600]}"
        state = "rows-only" if problem is None else "ok" if not problem or problem.startswith("slow") else "FAIL"
        failed += state == "FAIL"
        print(f"{state:9} {name:32} rows={n:<6} {took:5.2f}s {problem or ''}", flush=True)
    print("failed", failed, "of", len(queries))
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
