"""Command line: load season files, list the questions, answer one.

    python -m pitchside load <season_csv_dir> <star_root>
    python -m pitchside list
    python -m pitchside ask <question_id> <star_root> [--json <out_dir>] [--rows 50]
    python -m pitchside ask <question_id> --from-tables <sf_dir>     (star derived from the driver's tables)

``ask`` prints a numbered preview of each part (P6) and optionally writes the
whole result as JSON Lines (P8). No server is started.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="pitchside")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ld = sub.add_parser("load", help="season CSV files -> star schema")
    ld.add_argument("csv_dir")
    ld.add_argument("star_root")
    sub.add_parser("list", help="list the questions")
    ask = sub.add_parser("ask", help="answer one question from a written star")
    ask.add_argument("question_id")
    ask.add_argument("star_root", nargs="?")
    ask.add_argument("--from-tables", dest="tables_dir", help="derive the star from these parquet tables")
    ask.add_argument("--json", dest="json_dir")
    ask.add_argument("--rows", type=int, default=50)
    args = ap.parse_args(argv)

    from .plans.catalog import CATALOG, QuestionNotFound, run_question
    if args.cmd == "list":
        for q in CATALOG:
            parts = ", ".join(p for p in q.parts if p) or "-"
            print(f"{q.id}\t{q.title}\tparts: {parts}")
        return 0

    from .session import get_spark
    spark = get_spark()
    if args.cmd == "load":
        from .plans.ingest import load_seasons
        res = load_seasons(spark, args.csv_dir, args.star_root)
        print(f"loaded {res.counts.matches} matches, rejected {res.counts.rejected} rows")
        for reason, n in sorted(res.counts.reasons.items()):
            print(f"  {n}\t{reason}")
        return 0

    from .plans.sinks import write_json
    from .sources.star import read_star
    if args.tables_dir:
        from .sources.fixtures import fixture_star
        star = fixture_star(spark, args.tables_dir)
    elif args.star_root:
        star = read_star(spark, args.star_root)
    else:
        print("give a star root or --from-tables", file=sys.stderr)
        return 2
    try:
        parts = run_question(star, args.question_id)
    except QuestionNotFound:
        print(f"question {args.question_id} not found", file=sys.stderr)
        return 2
    def fetch(item):
        label, df = item
        if args.json_dir:
            write_json(df, f"{args.json_dir}/question_{args.question_id}{label}")
        return label, df.columns, df.count(), df.limit(args.rows).collect()   # rows in the question's order

    # Parts are independent jobs: run them concurrently, print them in order.
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=max(1, len(parts))) as pool:
        results = list(pool.map(fetch, parts.items()))
    for label, columns, total, rows in results:
        print(f"-- part {label or '-'}: {total} rows" + (f", first {args.rows} shown" if total > args.rows else ""))
        print("#\t" + "\t".join(columns))
        for i, row in enumerate(rows, start=1):
            print(f"{i}\t" + "\t".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
