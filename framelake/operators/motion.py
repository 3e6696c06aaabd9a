"""Shake, outliers and zoom from motion vectors; all aggregates combine before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import tables as T
from . import sequence


def magnitude(dx: Column, dy: Column) -> Column:
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def shake(vectors: DataFrame, video: str = "video", threshold: float = T.SHAKE_THRESHOLD) -> DataFrame:
    """(video, avg_motion, max_motion, significant, needs_stabilization)."""
    m = magnitude(F.col("dx"), F.col("dy"))
    out = vectors.groupBy(video).agg(F.avg(m).alias("avg_motion"), F.max(m).alias("max_motion"), F.avg((m > T.SIGNIFICANT_SHIFT).cast("double")).alias("significant"))
    return out.withColumn("needs_stabilization", F.coalesce((F.col("avg_motion") > threshold) | (F.col("significant") > T.SIGNIFICANT_SHARE), F.lit(False)))


def exact_median(rows: DataFrame, group: str, value: str, steps: int = 64) -> DataFrame:
    """(group, median) by counts that add up, so a hot group is never in one buffer.

    Values are counted by ranges of 1 / ``steps``; only the ranges in which the
    middle ranks fall are counted by value. Nulls don't count.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__x")).withColumn("__b", F.floor(F.col("__x") * steps))
    so_far = lambda by: F.sum("__n").over(Window.partitionBy("__g").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    blocks = own.groupBy("__g", "__b").agg(F.count("*").alias("__n"))
    placed = blocks.select("__g", "__b", (so_far("__b") - F.col("__n")).alias("__from"), so_far("__b").alias("__to"), F.sum("__n").over(Window.partitionBy("__g")).alias("__all"))
    low, high = F.expr("(__all - 1) div 2"), F.expr("__all div 2")
    middle = placed.where(((low >= F.col("__from")) & (low < F.col("__to"))) | ((high >= F.col("__from")) & (high < F.col("__to"))))
    chosen = own.join(middle, ["__g", "__b"]).groupBy("__g", "__b", "__x").agg(F.count("*").alias("__n"), F.first("__from").alias("__from"), F.first("__all").alias("__all"))
    inside = Window.partitionBy("__g", "__b").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = chosen.withColumn("__end", F.col("__from") + F.sum("__n").over(inside)).withColumn("__begin", F.col("__end") - F.col("__n"))
    holds = lambda rank: F.max(F.when((rank >= F.col("__begin")) & (rank < F.col("__end")), F.col("__x")))
    return ranked.groupBy(F.col("__g").alias(group)).agg(((holds(low) + holds(high)) / 2).alias("median"))


def outlier_frames(vectors: DataFrame, video: str = "video", frame: str = "frame") -> DataFrame:
    """(video, frame, motion, limit) of frames whose mean motion exceeds three times the video's exact median."""
    means = vectors.groupBy(video, frame).agg(F.avg(magnitude(F.col("dx"), F.col("dy"))).alias("motion"))
    medians = exact_median(means, video, "motion").select(F.col(video).alias("__v"), F.col("median").alias("__m"))
    return means.join(medians, F.col(video) == F.col("__v")).select(video, frame, "motion", (F.col("__m") * T.OUTLIER_FACTOR).alias("limit")).where("motion > limit")


def cleaned(vectors: DataFrame, video: str = "video", frame: str = "frame") -> DataFrame:
    """The vectors with those of outlier frames set to no motion."""
    bad = outlier_frames(vectors, video, frame).select(F.col(video).alias("__v"), F.col(frame).alias("__f"))
    joined = vectors.join(bad, (F.col(video) == F.col("__v")) & (F.col(frame) == F.col("__f")), "left")
    hit = F.col("__v").isNotNull()
    return joined.withColumns({"was_outlier": hit, "dx": F.when(hit, 0).otherwise(F.col("dx")), "dy": F.when(hit, 0).otherwise(F.col("dy"))}).drop("__v", "__f")


def camera_path(vectors: DataFrame, video: str = "video", frame: str = "frame", block_frames: int = 10_000) -> DataFrame:
    """(video, frame, idx, x, y): the sum of the mean shifts of all frames so far; sums within blocks of frames meet the blocks' totals."""
    means = vectors.groupBy(video, frame).agg(F.avg(F.col("dx").cast("double")).alias("mx"), F.avg(F.col("dy").cast("double")).alias("my"))
    placed = sequence.numbered(means, video, [frame], F.floor(F.col(frame) / block_frames)).withColumn("__b", F.floor((F.col("idx") - 1) / block_frames))
    totals = placed.groupBy(F.col(video).alias("__v"), F.col("__b").alias("__c")).agg(F.sum("mx").alias("__x"), F.sum("my").alias("__y"))
    before = Window.partitionBy("__v").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__v", "__c", F.coalesce(F.sum("__x").over(before), F.lit(0.0)).alias("__x"), F.coalesce(F.sum("__y").over(before), F.lit(0.0)).alias("__y"))
    inside = Window.partitionBy(video, "__b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumns({"x": F.sum("mx").over(inside), "y": F.sum("my").over(inside)}).join(starts, (F.col(video) == F.col("__v")) & (F.col("__b") == F.col("__c")))
    return joined.select(video, frame, "idx", (F.col("x") + F.col("__x")).alias("x"), (F.col("y") + F.col("__y")).alias("y"))


def stabilise(vectors: DataFrame, video: str = "video", frame: str = "frame", reach: int = 10) -> DataFrame:
    """(video, frame, shift_x, shift_y) that moves each frame onto the camera path smoothed over ``reach`` frames on either side."""
    path = camera_path(vectors, video, frame)
    smooth = lambda c: sequence.temporal_denoise(path.select(video, frame, "idx", c), video, "idx", c, reach).select(video, frame, (F.col("smooth") - F.col(c)).alias(f"shift_{c}"))
    return smooth("x").join(smooth("y"), [video, frame])


def zoom(vectors: DataFrame, width: int, height: int, video: str = "video") -> DataFrame:
    """(video, movement, zoom): the greater range of shifts, and the zoom that hides it."""
    move = F.greatest(F.max("dx") - F.min("dx"), F.max("dy") - F.min("dy")).cast("double")
    return vectors.groupBy(video).agg(move.alias("movement")).withColumn("zoom", S.zoom_percent(F.col("movement"), F.lit(float(width)), F.lit(float(height))))
