"""Command line: list the registered queries, run one over a folder of tables, or show its plan."""

from __future__ import annotations

import argparse
import sys

from lexiloom.plans.queries import queries
from lexiloom.session import build_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexiloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    for name, text in (("run", "run a query and write or show its result"), ("explain", "show a query's plan")):
        c = sub.add_parser(name, help=text)
        c.add_argument("query")
        c.add_argument("folder", help="folder with the tables")
        c.add_argument("--master", default=None)
        c.add_argument("--out", default=None, help="folder for the result as Parquet")
    a = p.parse_args(argv)
    known = queries()
    if a.command == "list":
        print("\n".join(known))
        return 0
    if a.query not in known:
        print(f"no such query: {a.query}", file=sys.stderr)
        return 2
    df = known[a.query](build_session(master=a.master), a.folder)
    if a.command == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.parquet(a.out)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
