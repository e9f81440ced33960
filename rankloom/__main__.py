"""Command line: list and run registered queries, profile, build derived tables, verify them."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from rankloom.plans import bundles, catalog


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rankloom", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("list", help="names of all queries")
    for name, text, key in (("run", "run one query", "query"), ("profile", "run one profile", "bundle"), ("build", "write derived tables", None), ("verify", "check the derived relations", None)):
        one = sub.add_parser(name, help=text)
        if key:
            one.add_argument(key, choices=sorted(catalog.queries() if key == "query" else bundles.BUNDLES))
        one.add_argument("--data", required=True, help="folder of the tables")
        one.add_argument("--out", required=name == "build", help="folder for the result, as Parquet; shown where it is not given")
        if name == "build":
            one.add_argument("--task", choices=bundles.BUILD)
    given = parser.parse_args(args)
    if given.what == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = spark or SparkSession.builder.appName("rankloom").getOrCreate()
    if given.what == "build":
        print("\n".join(bundles.build(spark, given.data, given.out, given.task)))
        return 0
    found = bundles.bundle(spark, given.data, given.bundle) if given.what == "profile" else {n: catalog.queries()[n](spark, given.data) for n in ([given.query] if given.what == "run" else ["check_clean"])}
    failed = 0
    for name, df in found.items():
        if given.out:
            df.write.mode("overwrite").parquet(f"{given.out}/{name}")
        else:
            print(name)
            df.show(truncate=False)
        if given.what == "verify":
            failed = df.first()["failed"]
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
