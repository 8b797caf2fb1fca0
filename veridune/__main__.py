"""python -m veridune list | run NAME SF_DIR [OUT] | sql NAME"""

from __future__ import annotations

import sys

from . import registry


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(f"{n}{'' if n in registry.SQL else '  (no SQL)'}" for n in registry.QUERIES))
        return 0
    if args[:1] == ["sql"] and len(args) == 2:
        print(registry.SQL.get(args[1], "no SQL"))
        return 0
    if args[:1] == ["run"] and len(args) in (3, 4):
        from pyspark.sql import SparkSession

        df = registry.QUERIES[args[1]](SparkSession.builder.getOrCreate(), args[2])
        df.write.mode("errorifexists").parquet(args[3]) if len(args) == 4 else df.show(50, truncate=False)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
