"""Command line: list the registered reports, run one, optionally save it.

    python -m ledgerlens list
    python -m ledgerlens run p17_loss_top10 --tables /root/testdata/sf0.01 [--show 20]
    python -m ledgerlens run r06_rfm_segments --tables DIR --out /shared/reports/rfm
    python -m ledgerlens sql p17_loss_top10        # the independent SQL check
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerlens")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered reports and the SURVEY ids they cover")
    run = sub.add_parser("run", help="run one report")
    run.add_argument("name")
    run.add_argument("--tables", required=True, help="folder with the parquet tables")
    run.add_argument("--show", type=int, default=20, help="rows to print (0: none)")
    run.add_argument("--out", help="write the full result as CSV to this folder")
    run.add_argument("--master", default=None, help="Spark master when no session exists")
    sql = sub.add_parser("sql", help="print the SQL check of one report")
    sql.add_argument("name")
    args = parser.parse_args(argv)

    from ledgerlens.plans.registry import load_all
    reports = load_all()
    if args.cmd == "list":
        for name, e in sorted(reports.items()):
            print(f"{name:45s} {' '.join(e.ids)}")
        return 0
    if args.name not in reports:
        print(f"unknown report {args.name}; see `python -m ledgerlens list`", file=sys.stderr)
        return 2
    if args.cmd == "sql":
        print(reports[args.name].sql or "(no SQL check)")
        return 0

    from pyspark.sql import SparkSession

    from ledgerlens.session import build_session, checkpoint_dir
    active = SparkSession.getActiveSession()
    spark = active or build_session(args.master or "local[*]")
    checkpoint_dir(spark)
    df = reports[args.name].fn(spark, args.tables)
    if args.out:
        from ledgerlens.sources.workbook import write_report_csv
        write_report_csv(df, args.out)
    if args.show:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
