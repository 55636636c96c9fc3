"""Command line: ``python -m orelode scan|extract|report|build-pack|import-dump PATH [--output FOLDER] [--all] [--raw]``.

``report``, ``build-pack`` and ``import-dump`` take a folder that ``extract`` has written; without its records they end with 1.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orelode import api, sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orelode")
    parser.add_argument("verb", choices=("scan", "extract", "report", "build-pack", "import-dump"))
    parser.add_argument("path")
    parser.add_argument("--output")
    parser.add_argument("--dump", help="folder of dumped images, for import-dump")
    parser.add_argument("--all", action="store_true", help="open every file, whatever its name")
    parser.add_argument("--raw", action="store_true", help="write the stored pixels too")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("orelode").getOrCreate()
    if args.verb == "scan":
        found = api.scan(spark, args.path)
        for name in ("titles", "extensions", "types"):
            found[name].show(50, truncate=False)
        return 0
    if args.verb == "extract":
        found = api.extract(spark, args.path, api.Options(scan_all=args.all, output=args.output, raw=args.raw))
        found["summary"].show(truncate=False)
        failed = found["records"].isEmpty() and not found["failures"].where("chain = ''").isEmpty()
        return 2 if failed else 0
    try:
        records = spark.read.json(f"{args.path}/records")
    except AnalysisException:
        print(f"no records under {args.path}", file=sys.stderr)
        return 1
    if args.verb == "report":
        for table in api.report(records).values():
            table.show(50, truncate=False)
    elif args.verb == "build-pack":
        images = spark.read.parquet(f"{args.path}/images")
        pack = api.build_pack(records.join(images, ["rom_id", "id"], "left"))
        copied = sinks.write_pack(pack, args.path, args.output or f"{args.path}/pack").agg(F.count_if("copied").alias("copied")).first()
        print(f"{copied.copied} images copied")
    else:
        merged = api.import_dump(records, api.dump_folder(spark, args.dump or args.path))
        matched, unmatched = merged["matched"].count(), merged["unmatched"].count()
        sinks.write_json(f"{args.path}/import_dump_report.json", {"matched": matched, "unmatched": unmatched})
        sinks.swap_table(merged["records"], f"{args.path}/records")
        print(f"{matched} matched, {unmatched} unmatched")
    return 0


if __name__ == "__main__":
    sys.exit(main())
