"""Run registered queries against their SQL checks: check.py [folder] [name ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as e  # noqa: E402
from tablewright.session import local_session  # noqa: E402
from tests.compare import difference, duck  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
con = duck(folder)
queries, checks = e.queries(), e.oracle_sql()
selected = [n for n in queries if not names or n in names or any(n.startswith(x[:-1]) for x in names if x.endswith("*"))]
bad = 0
for name in selected:
    start = time.time()
    try:
        df = queries[name](spark, folder)
        if name in checks:
            diff = difference(df, con, checks[name])
            status = "ok" if diff is None else f"DIFF {diff[:600]}"
        else:
            status = f"rows {len(df.collect())}"
    except Exception as error:  # noqa: BLE001
        status = f"ERROR {type(error).__name__} {str(error)[:700]}"
    bad += not status.startswith(("ok", "rows"))
    print(f"{name:28s} {time.time() - start:6.2f}s {status}", flush=True)
print(f"{len(selected)} queries, {bad} bad, {len(queries)} registered, {len(checks)} with SQL")
