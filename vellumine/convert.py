"""Command line: convert a folder of files, list what converts to what, or tell formats."""

from __future__ import annotations

import argparse
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.shared import checkpoint_root, cut
from vellumine.sinks.committed import write_files
from vellumine.sources import files
from vellumine.sources.formats import FORMATS, engine_table, formats, routes


def supported_targets(spark: SparkSession) -> DataFrame:
    """src, targets: what each format converts to here, directly or through others."""
    found = routes(engine_table(spark, ("native",)))
    writable = formats(spark).where("can_write").select(F.col("format").alias("dst"))
    return found.join(F.broadcast(writable), "dst", "left_semi").groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("targets"))


def diagnose(spark: SparkSession) -> DataFrame:
    """format, reads, writes: what this installation can do by itself, whatever the tables of formats say."""
    rows = [(f, f in files.READERS, f in files.WRITERS) for f, *_ in FORMATS]
    return spark.createDataFrame(rows, "format string, reads boolean, writes boolean")


def no_route(src: str, dst: str, targets: Sequence[str]) -> str:
    """Why a conversion can't be done, and what can."""
    able = f"; {src} converts to {', '.join(sorted(targets))}" if targets else f"; nothing reads {src}"
    return f"no route from {src} to {dst}{able}"


def save(converted: DataFrame, folder: str, target: str, on_conflict: str = "rename") -> DataFrame:
    """path, saved, error: the outputs as files of ``folder``, an address that driver and executors reach.

    Files are committed together when all are written (``sinks.committed``). On conflict a name is
    numbered, overwritten, skipped, or an error of that file; outputs of one stem are taken in the order of their paths.
    """
    folder = folder if "://" in folder else os.path.abspath(folder)
    done = cut(converted.select("path", "output", "error"), "converted")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    good = done.where("error is null").select(F.concat(stem, F.lit(f".{target}")).alias("name"), F.col("output").alias("content"), F.col("path").alias("source"))
    report = f"{checkpoint_root(converted.sparkSession)}/reports/{uuid.uuid4().hex}"
    write_files(good, folder, on_conflict=on_conflict, report=report)
    saved = converted.sparkSession.read.schema("source string, saved string, error string").json(report)
    failed = done.where("error is not null").select("path", F.lit(None).cast("string").alias("saved"), "error")
    return saved.withColumnRenamed("source", "path").unionByName(failed)


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vellumine")
    parser.add_argument("inputs", help="folders, globs or files, parted by commas")
    parser.add_argument("target", help="a format, or 'formats', 'targets' or 'diagnose' to list them")
    parser.add_argument("--out", default=".")
    parser.add_argument("--on-conflict", choices=("rename", "overwrite", "skip", "error"), default="rename")
    parser.add_argument("--not-recursive", action="store_true")
    parser.add_argument("--known-only", action="store_true", help="leave out files of unknown extensions")
    parser.add_argument("--delimiter", help="of delimited text; \\t for a tab")
    parser.add_argument("--pages", help="of a PDF, such as 1-3,5")
    parser.add_argument("--hidden-sheets", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    lists = {"formats": formats, "targets": supported_targets, "diagnose": diagnose}
    if args.target in lists:
        lists[args.target](spark).show(100, False)
        return 0
    if args.target not in files.WRITERS:
        print(f"nothing writes {args.target}; targets: {', '.join(sorted(files.WRITERS))}")
        return 2
    options = {"delimiter": args.delimiter and args.delimiter.replace("\\t", "\t"), "pages": args.pages, "hidden_sheets": args.hidden_sheets}
    found = files.scan(spark, args.inputs.split(","), recursive=not args.not_recursive, known_only=args.known_only)
    done = save(files.convert(found, args.target, **options), args.out, args.target, args.on_conflict)
    counts = {r["ok"]: r["n"] for r in done.groupBy(F.col("error").isNull().alias("ok")).agg(F.count("*").alias("n")).collect()}
    print(f"converted {counts.get(True, 0)}, failed {counts.get(False, 0)}")
    return int(counts.get(False, 0) > 0)


if __name__ == "__main__":
    raise SystemExit(main())
