"""python -m tokenecho QUERY DIR: runs a registered query and prints its rows as JSON lines.
python -m tokenecho --row NAME PATH...: runs a row of the study on its files."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .plans import catalog, rows


def main(args: list[str]) -> int:
    if len(args) > 2 and args[0] == "--row" and args[1] in rows.SOURCES:
        print(json.dumps(rows.measured({args[1]: tuple(args[2:])}, SparkSession.builder.getOrCreate(), skip_failures=False)[0]))
        return 0
    if len(args) != 2 or args[0] not in catalog.QUERIES:
        print(f"{__doc__}\nQueries: {', '.join(sorted(catalog.QUERIES))}\nRows: {', '.join(sorted(rows.SOURCES))}", file=sys.stderr)
        return 2
    for row in catalog.QUERIES[args[0]](SparkSession.builder.getOrCreate(), args[1]).toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
