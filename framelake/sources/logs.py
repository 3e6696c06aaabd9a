"""Facts from log and report text: motion vectors, quality metrics, loudness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import tables as T


def motion_vectors(lines: DataFrame, text: str = "line") -> DataFrame:
    """One row per ``(LM dx dy `` in a line, with its place (whole numbers only)."""
    find = lambda i: F.regexp_extract_all(text, F.lit(r"\(LM\s+(-?\d+)\s+(-?\d+)\s+"), F.lit(i))
    rows = lines.withColumn("__m", F.arrays_zip(find(1).alias("dx"), find(2).alias("dy")))
    return rows.select("*", F.posexplode("__m").alias("lm_idx", "__v")).select(*[c for c in lines.columns if c != text], "lm_idx", F.col("__v.dx").cast("int").alias("dx"), F.col("__v.dy").cast("int").alias("dy"))


def line_metrics(text: Column) -> dict[str, Column]:
    """The first ``PSNR...=`` and ``SSIM...=`` of a text; null without."""
    find = lambda name: F.nullif(F.regexp_extract(text, rf"{name}.*?=\s*([\d.]+)", 1), F.lit("")).try_cast("double")
    return {"psnr": find("PSNR"), "ssim": find("SSIM")}


def summary_metrics(text: Column, name: str) -> dict[str, Column]:
    """Mean, least and greatest of the per-frame values; a summary line's average replaces the mean."""
    values = F.transform(F.regexp_extract_all(text, F.lit(rf"{name}_y:\s*([\d.]+)"), F.lit(1)), lambda x: x.try_cast("double"))
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    stated = F.nullif(F.regexp_extract(text, rf"{name}\s+average:\s*([\d.]+)", 1), F.lit("")).try_cast("double")
    low = name.lower()
    return {low: F.coalesce(stated, mean), f"{low}_min": F.array_min(values), f"{low}_max": F.array_max(values)}


def vmaf(text: Column) -> dict[str, Column]:
    """vmaf, vmaf_min and vmaf_max of a report: an object (mean, min, max, each else vmaf, else 0) or a list of frames; null if neither."""
    one = F.from_json(text, "mean double, min double, max double, vmaf double")
    frames = F.filter(F.from_json(text, "array<struct<vmaf:double>>"), lambda x: x.isNotNull())
    scores = F.transform(frames, lambda x: F.coalesce(x["vmaf"], F.lit(0.0)))
    is_list, is_object = F.startswith(F.ltrim(text), F.lit("[")), F.startswith(F.ltrim(text), F.lit("{"))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    own = lambda c: F.coalesce(one[c], one["vmaf"], F.lit(0.0))
    pick = lambda obj, lst: F.when(is_object, obj).when(is_list & (F.size(scores) > 0), lst)
    return {"vmaf": pick(own("mean"), total / F.size(scores)), "vmaf_min": pick(own("min"), F.array_min(scores)), "vmaf_max": pick(own("max"), F.array_max(scores))}


def loudness(text: Column) -> dict[str, Column]:
    """The measured values of the loudness object inside a text; the defaults where it is missing."""
    found = F.coalesce(F.nullif(F.regexp_extract(text, r'(?s)(\{[^{}]*"input_i"[^{}]*\})', 1), F.lit("")), text)
    o = F.from_json(found, "input_i string, input_tp string, input_lra string, input_thresh string, target_offset string")
    take = lambda c, d: F.coalesce(o[c].try_cast("double"), F.lit(d))
    return {"measured_i": take("input_i", T.TARGET_LOUDNESS), "measured_tp": take("input_tp", T.TRUE_PEAK), "measured_lra": take("input_lra", T.LOUDNESS_RANGE), "measured_thresh": take("input_thresh", T.LOUDNESS_THRESHOLD), "target_offset": take("target_offset", 0.0)}


def progress(lines: DataFrame, text: str = "line") -> DataFrame:
    return lines.withColumn("message", S.progress_text(F.col(text)))
