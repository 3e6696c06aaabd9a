"""File catalogue: scans, classification, checksums, the model inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import tables as T
from ..operators import sequence


def is_video(path: Column) -> Column:
    return S.extension(path).isin(*T.VIDEO_EXTENSIONS)


def is_image(path: Column) -> Column:
    return S.extension(path).isin(*T.IMAGE_EXTENSIONS)


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    p = F.col(path)
    return files.withColumns({"ext": S.extension(p), "is_video": is_video(p), "is_image": is_image(p)})


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of a real folder; the contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")


def scan(files: DataFrame, folder: str, recursive: bool = True, path: str = "path") -> DataFrame:
    """Videos under a folder of a file table: (dir, name, path, ord), ord from 0 within the directory in name order."""
    own, under = S.directory(F.col(path)), F.lit(folder.rstrip("/"))
    inside = (own == under) | (F.startswith(own, F.concat(under, F.lit("/"))) if recursive else F.lit(False))
    found = files.where(inside & is_video(F.col(path))).select(own.alias("dir"), S.base_name(F.col(path)).alias("name"), F.col(path).alias("path"))
    # a directory is numbered by the beginnings of its names, so a large one is not in one task
    return sequence.numbered(found, "dir", ["name", "path"], F.substring("name", 1, 4), "ord").withColumn("ord", F.col("ord") - 1)


def expand(files: DataFrame, folders: list[str], singles: list[str], path: str = "path") -> DataFrame:
    """Paths of jobs: folders without their subfolders, and single files; what is no video is dropped."""
    own = S.directory(F.col(path))
    return files.where((own.isin(*[f.rstrip("/") for f in folders]) | F.col(path).isin(*singles)) & is_video(F.col(path)))


def checksums(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds sha256 of each row's bytes; null stays null."""
    return files.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(T.MODELS), "name string, filename string, size_mb int, description string, scale int")


def model_inventory(registry: DataFrame, cached: DataFrame) -> DataFrame:
    """Registered models with what is cached of them, and cached files that no model claims.

    ``cached`` has filename and size_bytes; of files of one name the largest counts.
    The registry is a fixed table of a few rows.
    """
    cached = cached.groupBy("filename").agg(F.max("size_bytes").alias("size_bytes"))
    mb = F.round(F.col("size_bytes") / (1024.0 * 1024.0), 1)
    known = F.broadcast(registry).join(cached, "filename", "left").select("name", "filename", "description", F.col("size_bytes").isNotNull().alias("cached"), mb.alias("actual_mb"))
    custom = cached.join(F.broadcast(registry), "filename", "left_anti").select(F.col("filename").alias("name"), "filename", F.lit("Custom model").alias("description"), F.lit(True).alias("cached"), mb.alias("actual_mb"))
    return known.unionByName(custom)


def cached_removals(registry: DataFrame, cached: DataFrame) -> DataFrame:
    """(name, removed): how many cached files clearing each registered model would remove, and under '*' clearing all.

    The files themselves are for a file system to delete; ``cached`` has filename.
    """
    counts = cached.groupBy("filename").agg(F.count("*").alias("removed"))
    one = registry.join(counts, "filename", "left").select("name", F.least(F.coalesce("removed", F.lit(0)), F.lit(1)).alias("removed"))
    return one.unionByName(counts.agg(F.coalesce(F.sum("removed"), F.lit(0)).alias("removed")).select(F.lit("*").alias("name"), "removed"))


def with_fallbacks(files: DataFrame, size: str = "size_bytes", duration: str = "duration") -> DataFrame:
    """Sizes and durations that could not be read (null) as 0."""
    return files.withColumns({size: F.coalesce(F.col(size), F.lit(0)), duration: F.coalesce(F.col(duration), F.lit(0.0))})


def accelerations(listing: Column) -> Column:
    """Names in a capability listing: the first line goes, the others are trimmed and lower-cased, empty ones dropped."""
    lines = F.split(F.trim(listing), "\n")
    return F.filter(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def model_paths(registry: DataFrame, listing: DataFrame, local: str = "models") -> DataFrame:
    """(name, path): a registered model's file in the listing; else the file of that name in the local folder; else null.

    ``listing`` has path. The registry is a fixed table of a few rows.
    """
    named = listing.select(S.base_name(F.col("path")).alias("filename"), "path", S.directory(F.col("path")).alias("dir"))
    preferred = F.min_by("path", F.struct((F.col("dir") == local).cast("int"), "path"))
    best = named.join(F.broadcast(registry.select("filename")), "filename", "left_semi").groupBy("filename").agg(preferred.alias("path"))
    return registry.join(best, "filename", "left").select("name", "path")
