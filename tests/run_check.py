"""Compare queries with their SQL: python tests/run_check.py [folder] [name prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

from scoretables.catalog import ORACLES, QUERIES  # noqa: E402
from scoretables.session import local_session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
want = sys.argv[2:]
spark, con = local_session(), connect(folder)
if os.environ.get("MAX_ROWS"):
    spark.conf.set("scoretables.maxGroupRows", os.environ["MAX_ROWS"])
bad = 0
for name, fn in QUERIES.items():
    if want and not any(name.startswith(w) for w in want):
        continue
    t0 = time.time()
    try:
        if name in ORACLES:
            problems = compare(spark, con, fn, ORACLES[name], folder)
            n = con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0]
        else:
            n, problems = fn(spark, folder).count(), []
        if n == 0:
            problems.append("empty")
    except Exception as e:  # noqa: BLE001
        problems, n = [f"{type(e).__name__}: {str(e)[:700]}"], -1
    bad += bool(problems)
    print(f"{'BAD ' if problems else 'ok  '}{name} rows={n} {time.time() - t0:.2f}s {'' if name in ORACLES else '(rows only)'}")
    for p in problems:
        print("     ", p[:1500])
print("bad:", bad)
