"""Run every registered query against its DuckDB twin (manual tool):
python tests/check_all.py [sf_dir] [name ...]"""
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from oracle import compare, duck  # noqa: E402
from rowsync.session import build_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = set(sys.argv[2:])
spark = build_session("local[8]", 8)
con = duck(sf)
qs, sqls = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in sqls:
            n = compare(df, con, sqls[name])
            print(f"OK   {name:32s} rows={n:<7d} {time.time()-t:5.1f}s", flush=True)
        else:
            n = df.count()
            print(f"ROWS {name:32s} rows={n:<7d} {time.time()-t:5.1f}s (no oracle)", flush=True)
    except Exception as e:  # noqa: BLE001
        bad += 1
        print(f"FAIL {name:32s} {type(e).__name__}: {str(e)[:1500]}", flush=True)
        if "-v" in only:
            traceback.print_exc()
print("failures:", bad)
