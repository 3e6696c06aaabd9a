"""Container probes: JSON text to typed streams, and the facts derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import tables as T

PROBE = (
    "format struct<filename:string,duration:string,bit_rate:string,format_name:string,format_long_name:string>,"
    "streams array<struct<codec_type:string,codec_name:string,codec_long_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,"
    "duration:string,bit_rate:string,channels:int,sample_rate:string,pix_fmt:string,profile:string,color_space:string,color_range:string,color_transfer:string,"
    "disposition:struct<default:int>,tags:struct<language:string>>>"
)


def parse_probe(probes: DataFrame, text: str = "probe") -> DataFrame:
    """Replaces probe JSON by duration, bit_rate, format_name, format_long_name and typed streams.

    A stream's index is its place. Numbers that don't parse are 0, missing strings ''.
    """
    p = F.from_json(F.col(text), PROBE)
    word = lambda c: F.coalesce(c, F.lit(""))
    whole = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))

    def stream(s: Column, i: Column) -> Column:
        return F.struct(
            i.cast("int").alias("index"), word(s["codec_type"]).alias("codec_type"), word(s["codec_name"]).alias("codec_name"), word(s["codec_long_name"]).alias("codec_long_name"),
            F.coalesce(s["width"], F.lit(0)).alias("width"), F.coalesce(s["height"], F.lit(0)).alias("height"), S.frame_rate(s["avg_frame_rate"], s["r_frame_rate"]).alias("fps"),
            S.safe_double(s["duration"]).alias("duration"), whole(s["bit_rate"]).alias("bit_rate"), F.coalesce(s["channels"], F.lit(0)).alias("channels"), whole(s["sample_rate"]).alias("sample_rate"),
            word(s["pix_fmt"]).alias("pixel_format"), word(s["profile"]).alias("profile"), word(s["color_space"]).alias("color_space"), word(s["color_range"]).alias("color_range"), word(s["color_transfer"]).alias("color_transfer"),
            (F.coalesce(s["disposition"]["default"], F.lit(0)) != 0).alias("is_default"), word(s["tags"]["language"]).alias("language"),
        )

    parsed = probes.withColumn("__p", p)
    f = F.col("__p.format")
    streams = F.transform(F.coalesce(F.col("__p.streams"), F.from_json(F.lit("[]"), PROBE.partition("streams ")[2])), stream)
    return parsed.withColumns({
        "duration": S.safe_double(f["duration"]), "bit_rate": whole(f["bit_rate"]), "format_name": word(f["format_name"]), "format_long_name": word(f["format_long_name"]), "streams": streams,
    }).drop("__p", text)


def media_info(media: DataFrame) -> DataFrame:
    """The flat facts of each container: first video stream, audio streams, HDR."""
    video = F.get(F.filter("streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    audio = F.filter("streams", lambda s: s["codec_type"] == "audio")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return media.withColumn("__v", video).withColumn("__a", audio).select(
        *[c for c in media.columns if c != "streams"],
        zero(F.col("__v.width")).alias("width"), zero(F.col("__v.height")).alias("height"), F.coalesce("__v.fps", F.lit(0.0)).alias("framerate"),
        F.col("__v").isNotNull().alias("has_video"), (F.size("__a") > 0).alias("has_audio"), F.coalesce(F.lower("__v.color_transfer").isin(*T.HDR_TRANSFERS), F.lit(False)).alias("is_hdr"),
        F.coalesce("__v.codec_name", F.lit("")).alias("video_codec"), F.transform("__a", lambda s: s["codec_name"]).alias("audio_codecs"),
        F.size("__a").alias("n_audio"), F.size("streams").alias("n_streams"),
    )


def needs(info: DataFrame) -> DataFrame:
    """Adds what a container needs: hdr, interpolate (below 30 fps), remux; and that shake is not known yet."""
    rate = F.col("framerate")
    wanted = F.array_compact(F.array(
        F.when(F.col("is_hdr"), "hdr"), F.when((rate > 0) & (rate < 30), "interpolate"), F.when(F.col("format_name").isin(*T.REMUX_FORMATS), "remux"),
    ))
    return info.withColumns({"needs_processing": wanted, "shake_detected": F.lit(False)})
