"""Run registered queries against their SQL: ``python tests/run_oracle.py [sf_dir] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

from redline import catalogue  # noqa: E402
from redline.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", 8, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.load_all()
    names = sys.argv[2:] or list(catalogue.QUERIES)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = catalogue.QUERIES[name](spark, sf_dir)
            if name in catalogue.ORACLES:
                ok, message = compare(df, con, catalogue.ORACLES[name])
            else:
                ok, message = True, f"{df.count()} rows (no SQL)"
        except Exception as exc:  # report and go on
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {time.time() - start:6.2f}s  {message}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
