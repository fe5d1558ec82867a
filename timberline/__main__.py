"""Query stored records from a shell: python -m timberline PATH 'QUERY' [--format table|text|json|csv|raw]."""

from __future__ import annotations

import argparse
import sys

from timberline.lang.errors import QueryError


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="timberline", description=__doc__)
    parser.add_argument("path", help="folder of records (Parquet)")
    parser.add_argument("query")
    parser.add_argument("--format", default="table", choices=("table", "text", "json", "csv", "raw"))
    parser.add_argument("--fields", help="columns to print, separated by commas")
    parser.add_argument("--count", action="store_true", help="print the number of rows only")
    parser.add_argument("--explain", action="store_true", help="print the plan only")
    parser.add_argument("--limit", type=int, default=1000, help="most rows to print")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from timberline import api
    from timberline.sources import sinks
    from timberline.sources.records import from_parquet

    spark = SparkSession.builder.appName("timberline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    records = from_parquet(spark, args.path)
    try:
        if args.explain:
            print(api.explain(records, args.query))
            return 0
        df = api.search(records, args.query).dataframe(sort=not args.count)
    except QueryError as e:
        print(f"error at {e.position}: {e.message}", file=sys.stderr)
        return 2
    if args.count:
        print(df.count())
        return 0
    columns = args.fields.split(",") if args.fields else None
    if args.format == "table":
        (df.select(*columns) if columns else df).show(args.limit, truncate=False)
    else:
        for row in sinks.lines(df, args.format, columns).limit(args.limit).toLocalIterator():
            print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
