"""Compare every registered query with its SQL: ``python tests/check_all.py sf_dir [names]``."""

import os
import sys
import time
import traceback

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import oracle  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    sql = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                oracle.compare(df, con, sql[name])
                state = "ok"
            else:
                state = f"rows {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            failed += 1
            state = "FAIL " + str(e)[:600]
            if names:
                traceback.print_exc()
        print(f"{name:28s} {time.time() - t:6.2f}s {state}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
