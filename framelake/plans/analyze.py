"""One row of findings for each video: its facts and its scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scene_counts(videos: DataFrame, cuts: DataFrame, key: str = "video") -> DataFrame:
    """(key, num_scenes): a video's cuts and one."""
    counted = cuts.groupBy(F.col(key).alias("__v")).agg(F.count("*").alias("__n"))
    return videos.select(key).join(counted, F.col(key) == F.col("__v"), "left").select(key, (F.coalesce("__n", F.lit(0)) + 1).alias("num_scenes"))


def remember(known: DataFrame, fresh: DataFrame, path: str = "path") -> DataFrame:
    """The cache of analyses by path with new ones added; a path that is known keeps its row."""
    return known.unionByName(fresh.join(known.select(path), path, "left_anti").dropDuplicates([path]))


def analyse(info: DataFrame, scenes: DataFrame, key: str = "video", listed: int = 20) -> DataFrame:
    """``info`` with total_scenes, scene_seconds and the first ``listed`` scenes as an array.

    Scenes are counted before they meet the facts; only the listed ones are gathered.
    """
    from ..operators.sequence import first_scenes

    totals = scenes.groupBy(F.col(key).alias("__v")).agg(F.count("*").alias("total_scenes"), F.sum(F.col("end_time") - F.col("start_time")).alias("scene_seconds"))
    first = first_scenes(scenes, key, listed).groupBy(F.col(key).alias("__w")).agg(F.array_sort(F.collect_list(F.struct("start_time", "end_time", "confidence"))).alias("scenes"))
    joined = info.join(totals, F.col(key) == F.col("__v"), "left").join(first, F.col(key) == F.col("__w"), "left")
    return joined.withColumn("total_scenes", F.coalesce("total_scenes", F.lit(0))).drop("__v", "__w")
