"""Command line: run a registered query over a directory of raw tables.

    python -m stockroom list
    python -m stockroom run reorder_recommendations --raw /data/raw --out /data/reports/reorder

With ``spark-submit`` the cluster's session is used; ``--master local[8]``
builds a local one.  The result is written as parquet (``--limit`` caps the
rows inside the plan); nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    from stockroom.plans.catalog import REGISTRY

    parser = argparse.ArgumentParser(prog="stockroom")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered query names")
    run = sub.add_parser("run", help="run one registered query and write it as parquet")
    run.add_argument("query", choices=sorted(REGISTRY))
    run.add_argument("--raw", required=True, help="directory of the raw parquet tables")
    run.add_argument("--out", required=True, help="output path (overwritten)")
    run.add_argument("--limit", type=int, default=None)
    run.add_argument("--master", default=None, help="e.g. local[8]; default: the cluster's")
    args = parser.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(sorted(REGISTRY)))
        return 0

    from stockroom.session import get_session
    from stockroom.sources.derived import Tables
    spark = get_session(args.master)
    df = REGISTRY[args.query].build(Tables(spark, args.raw))
    if args.limit:
        df = df.limit(args.limit)
    df.write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
