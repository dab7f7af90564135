"""Run every registered query against its DuckDB oracle (like the driver).

usage: python tests/run_oracle.py [sf_dir] [name-substring ...]
"""
import json
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from millrace.session import build_session  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
pats = sys.argv[2:]
spark = build_session("local[8]", shuffle_partitions=8)
con = duck(sf)
qs, os_ = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if pats and not any(p in name for p in pats):
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in os_:
            r = compare(df, con, os_[name])
        else:
            r = {"rows_spark": df.count(), "ok": True, "rows_only": True}
    except Exception as e:  # report and continue
        r = {"ok": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        traceback.print_exc()
    r["sec"] = round(time.time() - t, 2)
    bad += not r["ok"]
    print(name, json.dumps(r, default=str)[:1500], flush=True)
print("FAILED", bad, "of", len(qs))
