"""python -m quillon list | run NAME SF_DIR [OUT]"""

from __future__ import annotations

import argparse

from quillon import catalog, session


def main() -> None:
    p = argparse.ArgumentParser(prog="quillon")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query and show it, or write it as Parquet")
    run.add_argument("name", choices=sorted(catalog.queries()), metavar="NAME")
    run.add_argument("sf_dir")
    run.add_argument("out", nargs="?")
    args = p.parse_args()
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    df = catalog.queries()[args.name](session.local(), args.sf_dir)
    df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=False)


if __name__ == "__main__":
    main()
