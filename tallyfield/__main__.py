"""python -m tallyfield list | show QUERY FOLDER [ROWS] | write QUERY FOLDER TARGET: registered queries from the command line."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import registry


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if len(args) < 3 or args[0] not in ("show", "write") or args[1] not in registry.QUERIES or args[0] == "write" and len(args) < 4:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = registry.QUERIES[args[1]](spark, args[2])
    if args[0] == "show":
        out.show(int(args[3]) if len(args) > 3 else 20, False)
    else:
        out.write.mode("errorifexists").option("compression", "zstd").parquet(args[3])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
