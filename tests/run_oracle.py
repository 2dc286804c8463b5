"""Run all (or the named) registered queries against their reference SQL and print timings."""

from __future__ import annotations

import sys
import time
import traceback

import __spark_entry__ as entry
from millrace.session import local_session
from tests.oracle import compare, connect


def main() -> None:
    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("oracle-check", 8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for key, query in queries.items():
        if wanted and key not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if key in oracles:
                rows, problem = compare(df, con, oracles[key])
            else:
                rows, problem = len(df.collect()), None
        except Exception:
            rows, problem = -1, traceback.format_exc()[-1500:]
        if problem:
            bad.append(key)
        kind = "sql " if key in oracles else "rows"
        took = time.time() - start
        state = "FAIL" if problem else "ok  "
        print(f"{state} {kind} {key:32s} {rows:7d} {took:6.2f}s {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
