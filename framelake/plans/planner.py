"""Stage planning: which stages a container needs, their order, whether each would run, and when jobs run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as T


def stage_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(T.STAGES), "name string, category string, priority int, gpu boolean")


def _enabled(config: Mapping[str, str], stage: str, default: bool = True) -> bool:
    return config.get(f"stages.{stage}.enabled", str(default).lower()) == "true"


def plan_stages(info: DataFrame, target: tuple[int, int] | None = None, target_fps: float | None = None, config: Mapping[str, str] | None = None, requested: str | None = None) -> DataFrame:
    """Adds stages: detection, what the container's facts call for, what is always on, encoding.

    A non-empty ``requested`` array column replaces the plan as a whole.
    """
    config = dict(T.DEFAULT_CONFIG) if config is None else config
    wanted: list[Column] = [F.lit("detect")]
    if target:
        wanted.append(F.when((F.col("width") < target[0]) | (F.col("height") < target[1]), "upscale"))
    if target_fps:
        wanted.append(F.when((F.col("framerate") > 0) & (F.col("framerate") < target_fps), "interpolate"))
    if _enabled(config, "hdr_to_sdr", False):
        wanted.append(F.when(F.col("is_hdr"), "hdr"))
    wanted += [F.lit(s) for s in T.ALWAYS_ON if _enabled(config, s)]
    if _enabled(config, "speed", False):
        wanted.append(F.lit("speed"))
    plan = F.array_compact(F.array(*wanted, F.lit("encode")))
    return info.withColumn("stages", plan if requested is None else F.when(F.size(requested) > 0, F.col(requested)).otherwise(plan))


def ordered(stages: Column) -> Column:
    """Known stages in canonical order, then the others as they came; each once."""
    canon = F.array(*map(F.lit, T.STAGE_ORDER))
    return F.concat(F.array_intersect(canon, stages), F.array_except(stages, canon))


def should_run(stage: Column, target: tuple[int, int] | None = None, config: Mapping[str, str] | None = None, strict: bool = True, target_fps: float | None = None) -> Column:
    """struct(run, reason) for a stage and the container's facts beside it.

    ``strict`` follows the rule that frame rate and format targets never reach
    these checks, so those stages do not run; else ``target_fps`` counts.
    """
    config = dict(T.DEFAULT_CONFIG) if config is None else config
    yes, no = (lambda: F.struct(F.lit(True).alias("run"), F.lit(None).cast("string").alias("reason"))), (lambda why: F.struct(F.lit(False).alias("run"), F.lit(why).alias("reason")))
    off = [s for s, *_ in T.STAGES if s not in ("detect", "encode") and not _enabled(config, s)]
    checks: list[tuple[Column, Column]] = [(stage.isin(*off), no("Stage disabled"))] if off else []
    checks.append(((stage == "deblock") & F.col("video_codec").isin(*T.CLEAN_CODECS), no("Lossless codec - no deblocking needed")))
    checks.append(((stage == "denoise_video") & ((F.col("width") == 0) | (F.col("height") == 0)), no("No video stream")))
    if target is None:
        checks.append((stage == "upscale", no("No target resolution specified")))
    else:
        checks.append(((stage == "upscale") & (F.col("width") >= target[0]) & (F.col("height") >= target[1]), no("Already at target resolution")))
    if strict or not target_fps:
        checks.append((stage == "interpolate", no("No target framerate specified")))
    else:
        checks.append(((stage == "interpolate") & (F.col("framerate") >= target_fps), no("Already at or above target framerate")))
    checks.append((stage.isin("normalize_audio", "normalize_volume") & ~F.col("has_audio"), no("No audio stream")))
    checks.append((stage == "remux", no("No target format specified")))
    if float(config.get("stages.speed.factor", "1.0")) == 1.0:
        checks.append((stage == "speed", no("No speed change requested")))
    checks.append(((stage == "hdr") & ~F.col("is_hdr"), no("Content is not HDR")))
    known = stage.isin(*[s for s, *_ in T.STAGES])
    out = F.when(~known, no("Unknown stage"))
    for condition, verdict in checks:
        out = out.when(condition, verdict)
    return out.otherwise(yes())


def stage_matrix(planned: DataFrame, key: str, target: tuple[int, int] | None = None, config: Mapping[str, str] | None = None, strict: bool = True, target_fps: float | None = None) -> DataFrame:
    """(key, ord, stage, run, reason) for each planned stage in order."""
    rows = planned.select("*", F.posexplode(ordered(F.col("stages"))).alias("ord", "stage"))
    return rows.withColumn("__r", should_run(F.col("stage"), target, config, strict, target_fps)).select(key, "ord", "stage", "__r.run", "__r.reason")


def schedule(jobs: DataFrame, priority: str = "priority", seq: str = "seq", rows: int = 100_000) -> DataFrame:
    """Adds position: higher priority first, then in order of arrival.

    Jobs are numbered within ranges of arrival and the ranges' counts are added
    up. There are as many ranges as the jobs fill with ``rows`` each, so more jobs
    mean more tasks and no larger ones.
    """
    span = jobs.agg(F.min(seq).alias("__lo"), F.max(seq).alias("__hi"), F.count("*").alias("__all"))
    width = (F.col("__hi") - F.col("__lo") + 1) / F.ceil(F.col("__all") / rows)
    placed = jobs.join(F.broadcast(span), F.col("__all") > 0).withColumn("__b", F.floor((F.col(seq) - F.col("__lo")) / width)).drop("__lo", "__hi", "__all")
    counts = placed.groupBy(priority, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy(F.desc(priority), "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("__s", before).select(F.col(priority).alias("__p"), F.col("__b").alias("__c"), "__s")
    inside = F.row_number().over(Window.partitionBy(priority, "__b").orderBy(seq))
    numbered = placed.withColumn("__i", inside)
    joined = numbered.join(starts, F.col(priority).eqNullSafe(F.col("__p")) & F.col("__b").eqNullSafe(F.col("__c")))
    return joined.withColumn("position", F.col("__s") + F.col("__i")).drop("__b", "__p", "__c", "__s", "__i")


def add_jobs(files: DataFrame, path: str = "path", folder: Column | None = None) -> DataFrame:
    """Job rows with default output paths; rows whose file is missing (null size) raise."""
    from ..functions.scalar import output_path

    checked = F.when(F.col("size_bytes").isNull(), F.raise_error(F.concat(F.lit("no such input: "), F.col(path)))).otherwise(F.col(path)) if "size_bytes" in files.columns else F.col(path)
    return files.select(checked.alias("input_path"), output_path(F.col(path), folder).alias("output_path"))
