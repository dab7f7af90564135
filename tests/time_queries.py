"""Time registered queries with the noop sink: python tests/time_queries.py SF_DIR name..."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from millrace.session import build_session  # noqa: E402

sf = sys.argv[1]
spark = build_session("local[8]", shuffle_partitions=8)
qs = E.queries()
for name in sys.argv[2:]:
    for i in range(2):
        t = time.perf_counter()
        qs[name](spark, sf).write.format("noop").mode("overwrite").save()
        print(name, i, round(time.perf_counter() - t, 2), flush=True)
