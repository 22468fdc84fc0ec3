"""Check queries by name (or all): python tests/run_queries.py [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

import __spark_entry__ as e
from compare import difference, duck

from gaugeworks.session import build_session

if __name__ == "__main__":
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs, sql, con = e.queries(), e.oracle_sql(), duck(sf)
    for name in names or qs:
        t = time.time()
        try:
            df = qs[name](spark, sf)
            if name in sql:
                note = difference(df, con, sql[name])
                state = "ok" if note is None else "DIFF " + note[:600]
            else:
                rows = df.collect()
                state = f"rows {len(rows)} {str(rows[:1])[:200]}"
        except Exception as ex:  # report and go on
            state = "ERROR " + str(ex)[:900]
        print(f"{time.time() - t:6.2f}s {name}: {state}", flush=True)
