"""Two-pass loudness: measure each track, then apply one gain. RMS levels, not gated loudness units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T


def measure(blocks: DataFrame, track: str, sample: str) -> DataFrame:
    """(track, level_db, peak_db) of samples within -1 to 1; silence measures -70."""
    x = F.col(sample).cast("double")
    db = lambda v: F.when(v > 0, F.lit(20.0) * F.log10(v)).otherwise(-70.0)
    sums = blocks.groupBy(track).agg(F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs(x)).alias("peak"))
    return sums.select(track, db(F.col("rms")).alias("level_db"), db(F.col("peak")).alias("peak_db"))


def gain(level: Column, peak: Column, target: float = T.TARGET_LOUDNESS, true_peak: float = T.TRUE_PEAK) -> Column:
    """Decibels to the target, held below the peak limit."""
    return F.least(F.lit(target) - level, F.lit(true_peak) - peak)


def normalise(blocks: DataFrame, track: str, sample: str, target: float = T.TARGET_LOUDNESS, true_peak: float = T.TRUE_PEAK) -> DataFrame:
    """Adds gain_db and the normalised sample; the measurements join by track (a hot track is split by the adaptive join)."""
    gains = measure(blocks, track, sample).select(F.col(track).alias("__t"), gain(F.col("level_db"), F.col("peak_db"), target, true_peak).alias("gain_db"))
    joined = blocks.join(gains, F.col(track) == F.col("__t")).drop("__t")
    return joined.withColumn("normalised", F.col(sample) * F.pow(F.lit(10.0), F.col("gain_db") / 20.0))
