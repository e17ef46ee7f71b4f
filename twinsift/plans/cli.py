"""Command line: `python -m twinsift.plans.cli A [B]`. Exit codes: 0 done, 1 some files of an applied plan stayed, 2 bad input."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions import args
from twinsift.operators.refine import Comparison, compare_files
from twinsift.plans import disposal, matches, report
from twinsift.scratch import root
from twinsift.sources.flatdir import scan_folders, scan_once
from twinsift.sources.index import carried_over, read_kept, write_index, write_parquet_index


def folder_report(spark: SparkSession, folder: str, out: str, ext: list[str] | None = None, index: str | None = None, kept: str | None = None) -> DataFrame:
    """Scans a folder, writes the text report (and indexes) and returns the summary. None of them is scanned.

    `index` is where JSON lines go. `kept` is an index for the next run: where it is there already, files that are
    still as it has them are not read again; it is replaced by what is known now.
    """
    scan = scan_once(spark, [folder], ext, [p for p in (out, index, kept) if p])
    if index:
        write_index(scan.files, index)
    compared = compare_with(spark, scan.files, kept)
    report.write_report(compared.members, out, scanned=scan.scanned, errors=scan.failed)
    return report.report_summary(compared.members, scanned=scan.scanned, errors=scan.failed)


def compare_with(spark: SparkSession, files: DataFrame, kept: str | None) -> Comparison:
    """compare_files() of what the kept index doesn't know; the index is then brought up to date, beside the old one until it is whole."""
    if not kept:
        return compare_files(files)
    compared = compare_files(carried_over(files, read_kept(spark, kept)) if os.path.isdir(kept) else files)
    write_parquet_index(compared.index, f"{kept}.new")
    if os.path.isdir(kept):
        os.rename(kept, old := f"{kept}.{os.getpid()}.old")
        os.rename(f"{kept}.new", kept)
        for f in os.listdir(old):
            os.unlink(os.path.join(old, f))
        os.rmdir(old)
    else:
        os.rename(f"{kept}.new", kept)
    return compared


def compare(spark: SparkSession, a: str, b: str, ext: list[str] | None = None) -> DataFrame:
    """The confirmed files of both folders, each tagged with its side."""
    disposal.check_sides(a, b)
    sides = [scan_folders(spark, [f], ext)[0].withColumn("side", F.lit(s)) for f, s in ((a, "A"), (b, "B"))]
    return compare_files(sides[0].unionByName(sides[1])).members.drop("ranges").persist()


def same_folder(spark: SparkSession, folder: str, ext: list[str] | None = None) -> DataFrame:
    return compare_files(scan_folders(spark, [folder], ext)[0]).members.drop("ranges").persist()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="twinsift", description="Find byte-identical files.")
    parser.add_argument("folders", nargs="+", help="one folder: report; two: matches; the same twice: keep the newest")
    parser.add_argument("--ext", nargs="*", help="only these extensions")
    parser.add_argument("--report", default="twinsift-report", help="where the report goes")
    parser.add_argument("--index", help="where an index goes, as JSON lines")
    parser.add_argument("--kept", help="one folder: an index that is kept from run to run, so that only changed files are read")
    parser.add_argument("--lists", help="two folders: where each side's paths go, as JSON lines")
    parser.add_argument("--plan", help="where a list of files that could go is written")
    parser.add_argument("--side", choices=["A", "B"], default="B", help="two folders: whose files the plan names")
    parser.add_argument("--move-to", help="carry the plan out: its files are moved to this folder; without it, nothing is moved or removed")
    given = parser.parse_args(argv)
    try:
        folders = [str(args.folder(f)) for f in given.folders]
        ext = args.extensions(given.ext)
        if len(folders) > 2:
            raise args.ArgumentError("give one or two folders")
        if len(folders) == 2:
            disposal.check_sides(*folders)
        if given.move_to and (len(folders) == 1 or any(os.path.realpath(given.move_to) == f for f in folders)):
            raise args.ArgumentError("--move-to needs two folders and another one than these")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if len(folders) == 1:
        summary = folder_report(spark, folders[0], given.report, ext, given.index, given.kept)
        summary.show(truncate=False)
        print(f"The groups and their paths are in {given.report}.")
        return 0
    same = folders[0] == folders[1]
    files = same_folder(spark, folders[0], ext) if same else compare(spark, *folders, ext)
    (matches.same_summary if same else matches.cross_summary)(files).show()
    shown = matches.preview((matches.kept if same else matches.cross_groups)(files), ["size", "digest"]).persist()
    shown.show(50, truncate=False)
    matches.some_paths(files, shown).orderBy("place", "path").show(1000, truncate=False)
    if given.lists and not same:
        matches.write_side_lists(files, given.lists)
    if not given.plan and not given.move_to:
        return 0
    plan = disposal.plan_extras(files) if same else disposal.plan_side(files, given.side)
    if given.plan:
        plan.write.mode("overwrite").json(given.plan)
    if not given.move_to:
        return 0
    journal = f"{root(spark)}/journal-{os.urandom(8).hex()}"
    outcomes = {r["outcome"]: r["n"] for r in disposal.carry_out(plan, disposal.into_folder(os.path.realpath(given.move_to)), journal, dry_run=False).groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    print(", ".join(f"{k}: {n}" for k, n in sorted(outcomes.items())) or "nothing to move")
    return 1 if outcomes.keys() - {"done"} else 0


if __name__ == "__main__":
    sys.exit(main())
