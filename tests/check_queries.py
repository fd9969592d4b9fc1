"""Run queries against the checking SQL: `python tests/check_queries.py [sf] [name ...]`."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle
from amrspark.plans import catalog
from amrspark.session import build_session

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
names = sys.argv[2:] or list(catalog.QUERIES)
sf_dir = f"/root/testdata/sf{sf}"
spark = build_session(
    "local[8]",
    **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
)
spark.sparkContext.setLogLevel("ERROR")
con = oracle.connect(sf_dir)
bad = 0
for name in names:
    start = time.time()
    try:
        df = catalog.QUERIES[name](spark, sf_dir)
        if name in catalog.SQL:
            problem = oracle.compare(df, con, catalog.SQL[name])
        else:
            problem = f"(no sql) rows={df.count()}"
    except Exception as exc:
        problem = f"{type(exc).__name__}: {str(exc)[:700]}"
    bad += bool(problem) and not problem.startswith("(no sql)")
    print(f"{'ok ' if not problem else '-- '} {name} {time.time() - start:.1f}s {problem}", flush=True)
print(f"{len(names)} queries, {bad} bad")
