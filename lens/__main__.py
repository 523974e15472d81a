"""python -m lens [DIRECTORY] [-c SQL]: one query, or a server for PostgreSQL clients."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lens.errors import EngineError
from lens.session import Session, error_json, shown
from lens.wire.dashboard import Dashboard
from lens.wire.server import Server, refused

MOST_JSON_ROWS = 500


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lens", allow_abbrev=False, add_help=False)
    p.add_argument("directory", nargs="?", default=".")
    p.add_argument("-d", "--dir")
    p.add_argument("-c", "--command")
    p.add_argument("-H", "--host", default="127.0.0.1")
    p.add_argument("-p", "--port", type=int, default=5432)
    p.add_argument("--dashboard", action="store_true")
    p.add_argument("--dashboard-port", type=int, default=8080)
    p.add_argument("--no-cache", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("-h", "--help", action="help")
    p.add_argument("-V", "--version", action="version", version="lens 0.2")
    return p


def answer(session: Session, text: str, as_json: bool) -> int:
    try:
        if as_json:
            print(session.run(text, MOST_JSON_ROWS).to_json())
            return 0
        found, count = session.open(text), 0
        if found:
            print("\t".join(name for name, _ in found[0]))
            for row in found[1]:
                count += 1
                print("\t".join("" if v is None else shown(v) for v in row))
            print(f"SELECT {count}")
        return 0
    except EngineError as x:
        print(error_json(x) if as_json else f"ERROR {x.state}: {x.message}" + (f"\nHINT: {x.hint}" if x.hint else ""), file=sys.stdout if as_json else sys.stderr)
        return 1


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark, directory = SparkSession.builder.appName("lens").getOrCreate(), a.dir or a.directory
    if a.command is not None:
        return answer(Session(spark, directory, not a.no_cache), a.command, a.json)
    try:
        server = Server(spark, directory, a.host, a.port, not a.no_cache)
    except OSError as x:
        print(refused(x, a.host, a.port).message, file=sys.stderr)
        return 1
    print("lens answers on {}:{}".format(*server.server_address), flush=True)
    if a.dashboard:
        print("its queries are on http://{}:{}/".format(*Dashboard(server.log, a.host, a.dashboard_port).started().server_address), flush=True)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    return 0


if __name__ == "__main__":
    sys.exit(main())
