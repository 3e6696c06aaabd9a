"""Streaming variants (an extension of ours): new files, and scenes as frames arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import tables as T
from ..sources.files import classify


def watch_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of new files with their kind; contents are not kept."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return classify(files.select("path", "modificationTime", "length"))


def event_counts(events: DataFrame, time: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key; events later than ``late`` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


SCENES = "video string, start_time double, end_time double, confidence double"
STATE = "scene_start double, last_luma double, seen boolean"


def stream_scenes(frames: DataFrame, threshold: float = T.SCENE_THRESHOLD, shortest: float = T.MIN_SCENE_SECONDS) -> DataFrame:
    """Scenes of (video, t, luma) frames that arrive in order by video; the state is one row for each video.

    The tail after the last cut is not known while frames may still come, so it is not emitted.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, luma, seen = state.get if state.exists else (0.0, 0.0, False)
        out = []
        for batch in batches:
            for t, value in batch.sort_values("t")[["t", "luma"]].itertuples(index=False):
                score = abs(value - luma) / 255.0 if seen else 0.0
                if score > threshold:
                    if t - start >= shortest:
                        out.append((key[0], start, t, score))
                    start = t
                luma, seen = float(value), True
        state.update((float(start), float(luma), bool(seen)))
        yield pd.DataFrame(out, columns=["video", "start_time", "end_time", "confidence"])

    return frames.groupBy("video").applyInPandasWithState(step, SCENES, STATE, "append", GroupStateTimeout.NoTimeout)
