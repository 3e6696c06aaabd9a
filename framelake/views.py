"""The driver's tables seen as media records; operators know nothing of this binding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import sequence

EXTENSIONS = (".mp4", ".MKV", ".avi", ".jpg", ".txt", ".Mov", ".PNG", ".webm")
FORMATS = ("matroska", "mov,mp4,m4a,3gp,3g2,mj2", "mkv")
TRANSFERS = ("smpte2084", "ARIB-STD-B67", "bt709", "bt709", "bt709", "bt709", "bt709", "bt709")
VIDEO_CODECS = ("h264", "prores", "hevc", "vp9", "dnxhd")
AUDIO_CODECS = ("aac", "ac3", "opus")
MODEL_FOLDERS = ("/cache", "models", "/srv/shared")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(values: tuple[str, ...], i) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), pick(EXTENSIONS, F.col("p_partkey")))
    return p.select(F.concat(F.lit("/lib/"), "p_brand", F.lit("/"), name).alias("path"), (F.col("p_size") * 1000).cast("long").alias("size_bytes"), F.col("p_partkey").alias("file_id"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
    kind = F.when(F.col("l_returnflag") == "N", "video").when(F.col("l_returnflag") == "A", "audio").otherwise("subtitle")
    return rows.select(
        F.col("l_orderkey").alias("media_id"), "idx", kind.alias("codec_type"),
        F.when(kind == "video", pick(VIDEO_CODECS, F.col("l_suppkey"))).when(kind == "audio", pick(AUDIO_CODECS, F.col("l_suppkey"))).otherwise("srt").alias("codec_name"),
        (F.col("l_quantity") * 80).cast("int").alias("width"), (F.col("l_quantity") * 45).cast("int").alias("height"),
        F.concat((F.col("l_partkey") % 90).cast("string"), F.lit("/"), (F.col("l_suppkey") % 5).cast("string")).alias("rate"),
        pick(TRANSFERS, F.col("l_partkey")).alias("color_transfer"), (F.col("l_partkey") * 10).cast("string").alias("bit_rate"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, probe JSON) of each order with its line items as streams."""
    s = streams(spark, sf_dir)
    body = F.struct("idx", "codec_type", "codec_name", "width", "height", F.col("rate").alias("avg_frame_rate"), "color_transfer", "bit_rate")
    lists = s.groupBy("media_id").agg(F.array_sort(F.collect_list(body)).alias("streams"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_id"), F.struct((F.col("o_totalprice") / 1000).cast("string").alias("duration"), pick(FORMATS, F.col("o_custkey")).alias("format_name")).alias("format"))
    return o.join(lists, "media_id").select("media_id", F.to_json(F.struct("format", "streams")).alias("probe"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, event_id, us, luma, t): a scalar frame for each event, seconds from the video's first."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("luma"))
    first = rows.groupBy(F.col("video").alias("__v")).agg(F.min("us").alias("__f"))
    return rows.join(first, F.col("video") == F.col("__v")).withColumn("t", (F.col("us") - F.col("__f")).cast("double") / 1e6).drop("__v", "__f")


def indexed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames`` with idx, the place within the video, numbered day by day."""
    return sequence.numbered(frames(spark, sf_dir), "video", ["us", "event_id"], F.floor(F.col("us") / 86_400_000_000)).withColumn("idx", F.col("idx") - 1)


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, path, size_bytes): a model file for each part, half of them of registered names."""
    from .functions.tables import MODELS

    name = F.when(F.col("p_partkey") % 8 < 4, pick(tuple(m[1] for m in MODELS[:4]), F.col("p_partkey") % 4)).otherwise(F.concat(F.lit("own_"), F.col("p_partkey").cast("string"), F.lit(".pth")))
    rows = table(spark, sf_dir, "part").select(name.alias("filename"), pick(MODEL_FOLDERS, F.floor(F.col("p_partkey") / 8)).alias("dir"), (F.col("p_size") * 1000000).cast("long").alias("size_bytes"))
    return rows.select("filename", F.concat_ws("/", "dir", "filename").alias("path"), "size_bytes")


def vectors(spark: SparkSession, sf_dir: str, scale: int = 1) -> DataFrame:
    """(video, frame, dx, dy) motion vectors from line items."""
    price = F.round(F.col("l_discount") * 100).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video"), F.col("l_partkey").alias("frame"), ((F.col("l_quantity").cast("int") % 7 - 3) * scale).alias("dx"), ((price % 5 - 2) * scale).alias("dy"))


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, frame, pixels) from embeddings: a video for each label."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("video"), F.col("vec_id").alias("frame"), F.col("embedding").alias("pixels"))


def stage_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.tables import STAGE_ORDER

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(order).cast("int"))
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "completed").otherwise("skipped")
    return rows.select(
        F.col("l_orderkey").alias("job_id"), "ord", pick(STAGE_ORDER, F.col("ord") - 1).alias("stage"), status.alias("status"), F.col("l_quantity").alias("duration_sec"),
        F.when(status == "completed", F.concat(F.lit("/out/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("ord").cast("string"))).alias("output_path"),
        F.when(status == "failed", F.concat(F.lit("E"), F.col("l_suppkey").cast("string"))).alias("error"), F.concat(F.lit("/in/"), F.col("l_orderkey").cast("string")).alias("input_path"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("seq"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"))
