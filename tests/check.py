"""Run checked queries against their SQL: ``python tests/check.py [sf] [name...]``."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle import compare, connect  # noqa: E402

from tabkit.plans import QUERIES  # noqa: E402
from tabkit.session import local_session  # noqa: E402


def main():
    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name, q in QUERIES.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            problem = compare(df, con, q.sql) if q.sql else (None if df.count() else "no rows")
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - start
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {took:6.2f}s {'' if q.sql else '(rows only)'}", flush=True)
        if problem:
            failed.append(name)
            print("   ", problem[:2500], flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
