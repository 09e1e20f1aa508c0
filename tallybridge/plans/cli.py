"""Command line: link a ledger and a statement and write the result sheets."""

from __future__ import annotations

import argparse
import sys
import time
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, similarity
from ..operators import assign as S
from ..operators import results
from ..operators.explain import differences
from ..operators.scoring import ALGORITHMS, Thresholds, describe
from ..sources import tables, xlsx
from .linkage import A_NAME, B_NAME, Linkage, LinkageError, changed_rows, link


# --- fixed values: ranges of the thresholds ---
RANGES = {"high": (80, 100), "low": (50, 80), "floor": (0, 70)}
#: Scores that the sample for checking by eye is drawn from.
SAMPLED = (70.0, 95.0)


def _within(least: float, most: float):
    def number(text: str) -> float:
        x = float(text)
        if not least <= x <= most:
            raise argparse.ArgumentTypeError(f"{text} is not from {least} to {most}")
        return x

    return number


def show_inventory(paths: list[str]) -> None:
    """The sheets of the workbooks among the files."""
    for path in paths:
        if path.endswith(".xlsx"):
            try:
                print(f"{path}: {', '.join(xlsx.list_sheets(tables.check_file(path)))}")
            except (LinkageError, OSError, ValueError, zipfile.BadZipFile) as e:
                print(f"{path}: cannot be read: {e}")


def show_names(df: DataFrame, name: str, n: int) -> None:
    """The first names as they are, with their code points and what cleaning has to do with them, and the first that cleaning changes."""
    raw = cleaning.raw_name(F.col(f"`{name}`"))
    for r in df.select(raw.alias("raw"), cleaning.unicode_report(raw).alias("r")).limit(n).collect():
        found = "; ".join(f"{x.place}: {x.point} {x.meaning}".rstrip() for x in r.r.invisibles)
        print(f"{r.raw!r}: {r.r.codepoints} {r.r.categories}; surrounded by spaces: {r.r.surrounded}; invisible: {found or 'none'}")
    clean = cleaning.clean_name(F.col(f"`{name}`"))
    for r in changed_rows(df, name).select(raw.alias("raw"), clean.alias("clean"), cleaning.strip_punct(clean).alias("core")).limit(n).collect():
        print(f"{r.raw!r} -> {r.clean!r}, without punctuation {r.core!r}")


def show_sample(run: Linkage, n: int) -> None:
    """Some pairs between the bounds of ``SAMPLED`` with their differences, for checking by eye."""
    drawn = S.sample_band(run.done.where("matched"), *SAMPLED, n)
    a, b = run.a.select("a_idx", cleaning.raw_name(F.col(A_NAME)).alias("a_name")), run.b.select("b_idx", cleaning.raw_name(F.col(B_NAME)).alias("b_name"))
    shown = drawn.join(a, "a_idx").join(b, "b_idx")
    for side in "ab":
        shown = shown.withColumn(f"{side}_clean", cleaning.clean_name(F.col(f"{side}_name"))).withColumn(f"{side}_core", cleaning.strip_punct(F.col(f"{side}_clean"))).withColumn(f"{side}_bare", cleaning.strip_parens(F.col(f"{side}_clean")))
    shown = shown.withColumn("s", similarity.pair_scores("a_clean", "b_clean", "a_core", "b_core", "a_bare", "b_bare")).select("*", "s.ratio", "s.partial", "s.wratio", "s.core")
    for r in shown.withColumn("why", differences(F.col("a_name"), F.col("b_name"))).orderBy("a_idx").collect():
        print(f"{r.a_name} -> {r.b_name} ({r.score:.1f}): {'；'.join(r.why)}; ratio {r.ratio:.1f}, partial {r.partial:.1f}, weighted {r.wratio:.1f}, core {r.core:.1f}; mutual: {r.mutual}")


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tallybridge")
    p.add_argument("-A", "--a-file")
    p.add_argument("-B", "--b-file")
    p.add_argument("--a-sheet", default=tables.A_SHEET)
    p.add_argument("--b-sheet", default=tables.B_SHEET)
    for name, default in (("high", 90), ("low", 70), ("floor", 60)):
        least, most = RANGES[name]
        p.add_argument(f"--{name}", type=_within(least, most), default=default, help=f"threshold from {least} to {most}, {default} by default")
    p.add_argument("--algo", default="weighted", choices=list(ALGORITHMS))
    p.add_argument("--list-algo", action="store_true")
    p.add_argument("--blocking", choices=["bigram"])
    p.add_argument("-n", "--preview", type=int, default=3, help="rows of each preview")
    p.add_argument("--workers", type=int, default=-1, help="cores of a local run; all of them by default. Without effect where a session or a cluster is given")
    p.add_argument("--no-progress", action="store_true")
    p.add_argument("--team", default="team")
    p.add_argument("--out-dir", default="output")
    p.add_argument("--no-export", action="store_true")
    p.add_argument("--parquet", action="store_true", help="write parquet tables instead of a workbook")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: the input could not be read; 2: the results could not be written."""
    args = parse_args(argv)
    if args.list_algo:
        for name in ALGORITHMS:
            print(f"{name}: {describe(name)}")
        return 0
    if spark is None:
        builder = SparkSession.builder.appName("tallybridge").config("spark.ui.showConsoleProgress", str(not args.no_progress).lower())
        spark = (builder.master(f"local[{args.workers}]") if args.workers > 0 else builder).getOrCreate()
    started = time.time()
    try:
        thresholds = Thresholds(args.high, args.low, args.floor)
        describe(args.algo)
        if not (args.a_file and args.b_file):
            raise LinkageError("both --a-file and --b-file are needed")
        a, a_info = tables.load_ledger(spark, args.a_file, args.a_sheet)
        b, b_info = tables.load_statement(spark, args.b_file, args.b_sheet)
    except (LinkageError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    show_inventory([args.a_file, args.b_file])
    for info, df, name in ((a_info, a, A_NAME), (b_info, b, B_NAME)):
        print(f"{info.label}: {info.path}, header row {info.header_row + 1}, missing columns: {', '.join(info.missing) or 'none'}")
        show_names(df, name, args.preview)
    progress = None if args.no_progress else lambda done, what: print(f"{done:3d} % {what}", file=sys.stderr)
    run = link(a, b, thresholds=thresholds, algorithm=args.algo, blocking=args.blocking, progress=progress, log=print)
    run.summary.orderBy("place").show(20, False)
    run.statistics.show(1, False)
    run.matches.limit(args.preview).show(truncate=False)
    results.status_distribution(run.matches).show(truncate=False)
    show_sample(run, args.preview)
    wanted = run.claims.where("n > 1 AND rank = 1").orderBy(F.col("n").desc(), "b_idx").limit(args.preview).select("b_idx")
    run.claims.join(wanted, "b_idx").where(F.col("rank") <= args.preview).orderBy(F.col("n").desc(), "b_idx", "rank").show(args.preview**2, truncate=False)
    if not args.no_export:
        try:
            if args.parquet:
                tables.write_parquet(run, args.out_dir)
            else:
                path, counts = tables.export_workbook(run, args.out_dir, args.team)
                print(path, counts)
        except OSError as e:
            print(e, file=sys.stderr)
            return 2
    print(f"{time.time() - started:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
