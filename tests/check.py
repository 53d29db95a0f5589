"""Dev tool: python tests/check.py [sf_dir] [name ...] -> per-query oracle check."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kairos.session import get_spark  # noqa: E402
from tests.oracle_util import compare  # noqa: E402
import __spark_entry__ as entry  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    qs, orc = entry.queries(), entry.oracle_sql()
    names = args or list(qs)
    bad = 0
    for n in names:
        t = time.time()
        if n not in orc:
            try:
                rows = qs[n](spark, sf).count()
                print(f"{n:32s} rows-only {rows} ({time.time() - t:.1f}s)")
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"{n:32s} FAIL rows-only ERROR {type(e).__name__}: {str(e)[:800]}")
            continue
        try:
            probs, rows, h = compare(spark, n, sf, qs, orc)
        except Exception as e:  # noqa: BLE001
            probs, rows = [f"ERROR {type(e).__name__}: {str(e)[:800]}"], -1
        status = "OK" if not probs else "FAIL"
        bad += bool(probs)
        print(f"{n:32s} {status} rows={rows} ({time.time() - t:.1f}s)", *probs, sep="\n   " if probs else " ")
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
