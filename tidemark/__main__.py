"""Command line: ``python -m tidemark {query,load,console}``."""

from __future__ import annotations

import argparse
import cmd
import sys
import time

from tidemark.errors import QueryError
from tidemark.session import Engine, Result, cluster_session, local_session


def _print(result: Result, separator: str) -> None:
    for line in result.lines(separator):
        print(line)


class Console(cmd.Cmd):
    """Statements line by line; an empty line shows STATS and CLUSTER."""

    prompt = "> "

    def __init__(self, engine: Engine, separator: str = "\t") -> None:
        super().__init__()
        self.engine, self.separator = engine, separator

    def onecmd(self, line: str) -> bool:
        if line == "EOF":
            return True
        closed = False
        for statement in [line] if line.strip() else ["STATS", "CLUSTER"]:
            began = time.monotonic()
            try:
                result = self.engine.sql(statement)
                _print(result, self.separator)
                closed = closed or result.closed
            except QueryError as error:
                print(f"ERROR {error}")
            print(f"-- {time.monotonic() - began:.3f} s")
        return closed


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("--cores", default="*", help="threads of the local session")
    parser.add_argument("--warehouse", help="folder of the tables")
    parser.add_argument("--master", help="the cluster to run on; a local session if missing")
    parser.add_argument("--shared", help="with --master: a folder that all executors see")
    parser.add_argument("--buckets", type=int, help="buckets of new tables")
    parser.add_argument("--separator", default="\t")
    commands = parser.add_subparsers(dest="command", required=True)
    query = commands.add_parser("query", help="run one statement and print its result")
    query.add_argument("statement")
    query.add_argument("--export", help="write the rows to this folder instead")
    load = commands.add_parser("load", help="load separated text into a table")
    load.add_argument("table")
    load.add_argument("--file", nargs="*", help="standard input if missing")
    load.add_argument("--gzip", action="store_true", help="standard input is compressed")
    load.add_argument("--layout", choices=("lines", "stream"))
    commands.add_parser("console", help="statements from the terminal")
    chosen = parser.parse_args(arguments)
    if chosen.master and not chosen.shared:
        parser.error("--master needs --shared")
    session = cluster_session(chosen.master, chosen.shared, chosen.warehouse) if chosen.master else local_session(chosen.cores, chosen.warehouse)
    engine = Engine(session, chosen.buckets)
    separator = chosen.separator.encode().decode("unicode_escape")
    try:
        if chosen.command == "console":
            Console(engine, separator).cmdloop()
        elif chosen.command == "load":
            count, rejects = engine.load(chosen.table, chosen.file, separator, chosen.layout, chosen.gzip)
            print(f"{count} records loaded, {rejects.count()} rejected")
        else:
            result = engine.sql(chosen.statement)
            if chosen.export:
                result.export(chosen.export, separator)
            else:
                _print(result, separator)
    except QueryError as error:
        print(f"ERROR {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
