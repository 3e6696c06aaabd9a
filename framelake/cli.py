"""``python -m framelake.cli``: scan, plan, process, analyze, find-duplicates, presets, over real folders, probe files and tables of frames.

Exit codes: 0 done, 1 nothing found or an input that cannot be read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plugins
from .functions import tables as T
from .operators import fingerprint, sequence
from .plans import planner
from .sources import config, files, probe


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="framelake")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="list videos of a folder")
    scan.add_argument("folder")
    scan.add_argument("--flat", action="store_true")
    plan = commands.add_parser("plan", help="plan stages from files of probe JSON, one a line")
    plan.add_argument("probes")
    plan.add_argument("--preset", choices=[p[0] for p in T.PRESETS])
    process = commands.add_parser("process", help="plan jobs and run the registered plug-in stages on tables of frames")
    process.add_argument("probes")
    process.add_argument("--preset", choices=[p[0] for p in T.PRESETS])
    process.add_argument("--frames", help="Parquet table of frames to run the stages on")
    process.add_argument("--output", help="folder of the processed frames")
    process.add_argument("--dry-run", action="store_true")
    analyze = commands.add_parser("analyze", help="scenes of a Parquet table of frames (video, t, luma)")
    analyze.add_argument("frames")
    twins = commands.add_parser("find-duplicates", help="videos like one of a Parquet table of frames (video, pixels)")
    twins.add_argument("frames")
    twins.add_argument("video")
    twins.add_argument("--threshold", type=float, default=T.SIMILARITY_THRESHOLD)
    commands.add_parser("presets", help="list presets")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("framelake").getOrCreate()
    try:
        return COMMANDS[args.command](spark, args)
    except AnalysisException as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1


def show(rows: DataFrame) -> int:
    """Prints all rows, one partition at a time, and tells how many there were."""
    n = 0
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in row))
        n += 1
    return n


def _scan(spark: SparkSession, args: argparse.Namespace) -> int:
    found = files.classify(files.list_files(spark, args.folder, not args.flat)).where("is_video").orderBy("path")
    if found.isEmpty():
        print("no videos", file=sys.stderr)
        return 1
    show(found.select("path", "length"))
    return 0


def _planned(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    chosen = next((p for p in T.PRESETS if p[0] == args.preset), None)
    media = probe.parse_probe(spark.read.text(args.probes).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("probe")))
    target, fps = ((chosen[1], chosen[2]) if chosen[1] else None, chosen[3]) if chosen else (None, None)
    return planner.plan_stages(probe.media_info(media), target, fps).withColumn("stages", planner.ordered(F.col("stages")))


def _plan(spark: SparkSession, args: argparse.Namespace) -> int:
    return 0 if show(_planned(spark, args).select("id", "width", "height", F.array_join("stages", ", ").alias("stages"))) else 1


def _process(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.dry_run or not args.frames or not args.output:
        return _plan(spark, args)
    wanted = [r["s"] for r in _planned(spark, args).select(F.explode("stages").alias("s")).distinct().collect()]  # of a fixed list of stages
    names = [s for s in T.STAGE_ORDER if s in wanted]
    rows, skipped = plugins.run_chain(spark.read.parquet(args.frames), names)
    rows.write.mode("overwrite").parquet(args.output)
    print(f"ran {len(names) - len(skipped)} stages, skipped: {', '.join(skipped)}")
    return 0


def _analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    frames = spark.read.parquet(args.frames)
    block = F.floor(F.col("t") / 3600)
    scenes = sequence.scene_segments(sequence.difference_scores(frames, "video", ["t"], "luma", block), block=block)
    return 0 if show(sequence.first_scenes(scenes).orderBy("video", "place")) else 1


def _find_duplicates(spark: SparkSession, args: argparse.Namespace) -> int:
    prints = fingerprint.fingerprints(spark.read.parquet(args.frames))
    if prints.where(F.col("video").cast("string") == args.video).isEmpty():
        print("no such video", file=sys.stderr)
        return 1
    show(fingerprint.find_similar(prints.withColumn("video", F.col("video").cast("string")), args.video, threshold=args.threshold).orderBy(F.desc("similarity"), "video"))
    return 0


def _presets(spark: SparkSession, args: argparse.Namespace) -> int:
    show(config.presets(spark).select("name", "target_w", "target_h", "fps", "video_codec", "crf", "speed"))
    return 0


COMMANDS = {"scan": _scan, "plan": _plan, "process": _process, "analyze": _analyze, "find-duplicates": _find_duplicates, "presets": _presets}


if __name__ == "__main__":
    sys.exit(main())
