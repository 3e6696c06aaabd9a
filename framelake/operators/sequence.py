"""Operators over frames ordered within a video.

A video may hold a third of all frames, so nothing needs a video's frames in one
task: ``previous`` looks back within blocks of a video, and only the blocks' last
rows meet in a window per video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T


def previous(rows: DataFrame, video: str, order: list[str], values: list[str], block: Column) -> DataFrame:
    """Adds ``prev``, the struct of ``values`` of the row before (null for a video's first).

    ``block`` must not fall along ``order``; it cuts a video into pieces of bounded size.
    """
    own = rows.withColumn("__b", block)
    inside = Window.partitionBy(video, "__b").orderBy(*order)
    marked = own.withColumns({"__p": F.lag(F.struct(*values)).over(inside), "__first": F.row_number().over(inside) == 1})
    tails = own.groupBy(video, "__b").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__t"))
    carried = tails.select(F.col(video).alias("__v"), F.col("__b").alias("__c"), F.lag("__t").over(Window.partitionBy(video).orderBy("__b")).alias("__t"))
    joined = marked.join(carried, (F.col(video) == F.col("__v")) & (F.col("__b") == F.col("__c")), "left")
    return joined.withColumn("prev", F.when(F.col("__first"), F.col("__t")).otherwise(F.col("__p"))).drop("__b", "__p", "__first", "__t", "__v", "__c")


def numbered(rows: DataFrame, group: str, order: list[str], block: Column, name: str = "idx") -> DataFrame:
    """Adds the place (from 1, a long) within the group: places within blocks, and the counts of the blocks before.

    ``block`` must not fall along ``order``; it cuts a group into pieces of bounded size.
    """
    own = rows.withColumn("__b", block)
    counts = own.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__c")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__g", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    inside = F.row_number().over(Window.partitionBy(group, "__b").orderBy(*order))
    joined = own.withColumn("__i", inside).join(starts, F.col(group).eqNullSafe(F.col("__g")) & F.col("__b").eqNullSafe(F.col("__c")))
    return joined.withColumn(name, F.col("__s") + F.col("__i")).drop("__b", "__i", "__g", "__c", "__s")


def difference_scores(frames: DataFrame, video: str, order: list[str], luma: str, block: Column) -> DataFrame:
    """Adds score: the change of a scalar luma against the frame before, of 255 (0 for the first)."""
    return previous(frames, video, order, [luma], block).withColumn("score", F.coalesce(F.abs(F.col(luma) - F.col(f"prev.{luma}")) / 255.0, F.lit(0.0))).drop("prev")


def frame_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two pixel arrays, of 255."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a) / 255.0


def scene_segments(scored: DataFrame, video: str = "video", time: str = "t", score: str = "score", threshold: float = T.SCENE_THRESHOLD, shortest: float = T.MIN_SCENE_SECONDS, block: Column | None = None) -> DataFrame:
    """Scenes (video, start_time, end_time, confidence).

    A frame whose score exceeds the threshold is a cut. The stretch from the cut
    before (or 0) to a cut is a scene if it is long enough, else it is dropped;
    its confidence is the cut's score. What follows the last cut is a scene of
    confidence 0.5, however short, unless it is empty.
    """
    block = F.floor(F.col(time) / 1e6) if block is None else block
    cuts = scored.where(F.col(score) > threshold).groupBy(video, time).agg(F.max(score).alias(score))
    stretches = previous(cuts, video, [time], [time], block).withColumn("start_time", F.coalesce(F.col(f"prev.{time}"), F.lit(0.0)))
    found = stretches.where(F.col(time) - F.col("start_time") >= shortest).select(video, "start_time", F.col(time).alias("end_time"), F.col(score).alias("confidence"))
    ends = scored.groupBy(video).agg(F.coalesce(F.max(F.when(F.col(score) > threshold, F.col(time))), F.lit(0.0)).alias("start_time"), F.max(time).alias("end_time"))
    return found.unionByName(ends.where("start_time < end_time").withColumn("confidence", F.lit(0.5)))


def sample_even(frames: DataFrame, video: str, idx: str, target: int = 30) -> DataFrame:
    """Every (total div target)-th frame, at least every one; pre-aggregated counts are joined, not windowed."""
    totals = frames.groupBy(F.col(video).alias("__v")).agg(F.count("*").alias("__n"))
    joined = frames.join(totals, F.col(video) == F.col("__v"))
    return joined.where(F.col(idx) % F.greatest(F.lit(1), F.expr(f"__n div {target}")) == 0).drop("__v", "__n")


def sample_interval(frames: DataFrame, idx: str, fps: float, seconds: float, most: int = 20) -> DataFrame:
    """Every max(1, int(fps * seconds))-th frame, at most ``most`` of a video."""
    step = max(1, int(fps * seconds))
    return frames.where((F.col(idx) % step == 0) & (F.col(idx) < most * step))


def sample_seconds(frames: DataFrame, video: str, idx: str, time: str) -> DataFrame:
    """The first frame of each whole second."""
    return frames.groupBy(video, F.floor(time).alias("second")).agg(F.min(idx).alias(idx))


def extract(frames: DataFrame, video: str, idx: str, fps: float, start: float = 0.0, end: float | None = None, most: int | None = None) -> DataFrame:
    """Frames from second ``start`` on, as many as the span or ``most`` allows.

    A start before the video counts as its first frame and one beyond it as its
    last. With an end, a ``most`` of 0 is no limit.
    """
    rate = fps if fps > 0 else 30.0
    span = None if end is None else int((end - start) * rate)
    limit = most if span is None else min(most or span, span)
    ends = frames.groupBy(F.col(video).alias("__v")).agg(F.max(idx).alias("__end"))
    first = F.greatest(F.lit(0), F.least(F.lit(int(start * rate)), F.col("__end")))
    out = frames.join(ends, F.col(video).eqNullSafe(F.col("__v"))).where(F.col(idx) >= first)
    return (out if limit is None else out.where(F.col(idx) < first + limit)).drop("__v", "__end")


def with_times(frames: DataFrame, times: DataFrame, video: str, idx: str, time: str = "t") -> DataFrame:
    """Adds ``time``: the timestamp of the same video and place in ``times``.

    A video without any timestamp is timed by its places; a place beyond a
    video's list gets 0.0. Repeated timestamps of a place count as the least.
    """
    listed = times.groupBy(video, idx).agg(F.min(time).alias(time))
    timed = listed.select(video).distinct().withColumn("__timed", F.lit(True))
    joined = frames.join(listed, [video, idx], "left").join(timed, video, "left")
    return joined.withColumn(time, F.when(F.col("__timed"), F.coalesce(time, F.lit(0.0))).otherwise(F.col(idx).cast("double"))).drop("__timed")


def pairs(frames: DataFrame, video: str, idx: str, values: list[str], interval: int = 1, block_frames: int = 100_000) -> DataFrame:
    """Adjacent frames, kept where the later one's index is a multiple of the interval."""
    block = F.floor(F.col(idx) / block_frames)
    return previous(frames, video, [idx], [idx, *values], block).where(F.col("prev").isNotNull() & (F.col(idx) % interval == 0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays; null for constant ones or different sizes."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = lambda x, y: F.zip_with(x, y, lambda u, v: u.cast("double") * v)
    mean = lambda x: total(F.transform(x, lambda v: v.cast("double"))) / n
    centred = lambda x: F.transform(F.transform(x, lambda v: F.struct(v.cast("double").alias("v"), mean(x).alias("m"))), lambda s: s["v"] - s["m"])
    x, y = centred(a), centred(b)
    return F.when(F.size(a) == F.size(b), F.try_divide(total(product(x, y)), F.nullif(F.sqrt(total(product(x, x))) * F.sqrt(total(product(y, y))), F.lit(0.0))))


def interpolate(frames: DataFrame, video: str, idx: str, value: str, factor: int = 2, block_frames: int = 100_000) -> DataFrame:
    """Between adjacent frames, factor - 1 blended ones; (video, pos, value), pos = idx * factor for given frames."""
    given = frames.select(video, (F.col(idx) * max(1, factor)).alias("pos"), F.col(value).cast("double").alias("value"))
    if factor <= 1:
        return given
    both = previous(frames.select(video, idx, value), video, [idx], [idx, value], F.floor(F.col(idx) / block_frames)).where("prev IS NOT NULL")
    t = F.col("j") / F.lit(float(factor))
    made = both.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(factor - 1)))).select(video, (F.col(f"prev.{idx}") * factor + F.col("j")).alias("pos"), ((1.0 - t) * F.col(f"prev.{value}") + t * F.col(value)).alias("value"))
    return given.unionByName(made)


def temporal_denoise(frames: DataFrame, video: str, idx: str, value: str, reach: int = 2) -> DataFrame:
    """The mean of each frame and up to ``reach`` on either side, by a shuffle of shifted copies with partial sums."""
    near = frames.select(video, F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.struct((F.col(idx) + d).alias("i"), F.col(value).cast("double").alias("x")))).alias("s"))
    means = near.select(F.col(video).alias("__v"), "s.i", "s.x").groupBy("__v", "i").agg(F.avg("x").alias("smooth"))
    return frames.join(means, (F.col(video) == F.col("__v")) & (F.col(idx) == F.col("i"))).drop("__v", "i")


def retime(frames: DataFrame, time: str, factor: float) -> DataFrame:
    """Times for a speed factor; 1.0 leaves the frames as they are."""
    return frames if factor == 1.0 else frames.withColumn(time, F.col(time) / factor)


def first_scenes(scenes: DataFrame, video: str = "video", most: int = 20) -> DataFrame:
    """Each video's first scenes by time; Spark limits within tasks before the shuffle."""
    order = Window.partitionBy(video).orderBy("start_time", "end_time")
    return scenes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
