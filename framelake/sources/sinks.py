"""Writers: frames by video, tables in another format, presets and reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_frames(frames: DataFrame, folder: str, video: str = "video", buckets: int | None = None) -> None:
    """Frames as Parquet in a folder for each video; a long video is spread over ``buckets`` files."""
    dealt = frames if buckets is None else frames.withColumn("__b", F.pmod(F.xxhash64("frame_idx"), F.lit(buckets))).repartition(video, "__b").drop("__b")
    dealt.write.mode("overwrite").partitionBy(video).parquet(folder)


def remux(table: DataFrame, folder: str, form: str = "orc") -> None:
    """The same rows in another container format."""
    table.write.mode("overwrite").format(form).save(folder)


def write_reports(reports: DataFrame, folder: str, text: str = "report") -> None:
    reports.select(F.col(text).alias("value")).write.mode("overwrite").text(folder, lineSep="\n\n")
