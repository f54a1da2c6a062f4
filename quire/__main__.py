"""python -m quire NAME... --data DIR --out DIR: run registered queries and
write each as Parquet (or JSON lines). Under spark-submit the session is the
cluster's; otherwise a local one is made."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.catalog import QUERIES
from .session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("names", nargs="*", help="queries; none lists them")
    p.add_argument("--data", help="folder of the tables")
    p.add_argument("--out", help="folder of the results")
    p.add_argument("--format", choices=("parquet", "json"), default="parquet")
    p.add_argument("--cores", default="*")
    a = p.parse_args(argv)
    if not a.names:
        print("\n".join(sorted(QUERIES)))
        return 0
    if unknown := [n for n in a.names if n not in QUERIES]:
        p.error(f"no such query: {', '.join(unknown)}")
    if not a.data or not a.out:
        p.error("--data and --out are needed")
    spark = SparkSession.getActiveSession() or local_session(a.cores)
    for name in a.names:
        QUERIES[name](spark, a.data).write.mode("overwrite").format(a.format).save(f"{a.out}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
