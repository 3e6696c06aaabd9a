"""Full-reference quality of paired frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The constants of SSIM for a peak of 1.
C1, C2 = 0.01**2, 0.03**2


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mse(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))) / F.size(a)


def psnr(error: Column, peak: float = 1.0, most: float = 100.0) -> Column:
    """Decibels; ``most`` for equal frames."""
    return F.when(error == 0, F.lit(most)).otherwise(F.lit(10.0) * F.log10(F.lit(peak * peak) / error))


def ssim(a: Column, b: Column) -> Column:
    """The structural similarity of two whole frames (one window)."""
    n = F.size(a)
    wide = lambda x: F.transform(x, lambda v: v.cast("double"))
    mean = lambda x: _sum(wide(x)) / n
    second = lambda x, y: _sum(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))) / n
    ma, mb = mean(a), mean(b)
    va, vb, cov = second(a, a) - ma * ma, second(b, b) - mb * mb, second(a, b) - ma * mb
    return ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def compare(reference: DataFrame, distorted: DataFrame, keys: list[str], pixels: str = "pixels") -> DataFrame:
    """mse, psnr and ssim of frames that share the keys."""
    d = distorted.select(*keys, F.col(pixels).alias("__d"))
    both = reference.select(*keys, F.col(pixels).alias("__r")).join(d, keys)
    return both.withColumn("mse", mse(F.col("__r"), F.col("__d"))).withColumns({"psnr": psnr(F.col("mse")), "ssim": ssim(F.col("__r"), F.col("__d"))}).drop("__r", "__d")


def summarise(frames: DataFrame, keys: list[str]) -> DataFrame:
    metrics = ("psnr", "ssim")
    return frames.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
