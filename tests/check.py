"""python tests/check.py [sf dir] [name prefix ...]: compare registered queries with their SQL."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from tests.compare import compare, connect  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    import __spark_entry__ as entry
    from statewatch.session import local_session

    spark = local_session(8)
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = connect(sf)
    bad = 0
    for name, fn in queries.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        start = time.time()
        try:
            if name in oracle:
                message = compare(spark, sf, fn, oracle[name], con)
            else:
                n = fn(spark, sf).count()
                message = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            message = f"{type(e).__name__}: {str(e)[:900]}"
        bad += message is not None
        print(f"{'ok  ' if message is None else 'FAIL'} {name} {time.time() - start:.2f}s"
              f"{'' if name in oracle else ' (rows only)'} {message or ''}", flush=True)
    print(f"{bad} failing", flush=True)


main()
