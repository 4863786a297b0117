"""CLI: compare every registered query with its oracle.  Usage: python tests/check_oracles.py [sf_dir] [key...]"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402

from cohortflow.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = build_session()
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in keys or list(qs):
        t0 = time.time()
        if name not in orc:
            df = qs[name](spark, sf_dir)
            n = df.count()
            print(json.dumps({"name": name, "rows_only": n, "sec": round(time.time() - t0, 2)}))
            continue
        try:
            r = compare(spark, name, qs[name], orc[name], sf_dir, con)
        except Exception as exc:  # report and continue
            r = {"name": name, "error": repr(exc)[:2000]}
        r["sec"] = round(time.time() - t0, 2)
        if not r.get("values_match"):
            bad += 1
        print(json.dumps(r, default=str))
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
