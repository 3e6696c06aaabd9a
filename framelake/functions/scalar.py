"""Scalar rules as Column expressions; they stay in generated code, without Python on the executors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def safe_double(text: Column) -> Column:
    """A number, or 0.0 for null and garbage."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def frame_rate(average: Column, real: Column | None = None) -> Column:
    """``a/b`` as a quotient, 0.0 for b = 0; a plain number as it is; else 0.0. An empty average falls back to ``real``."""
    text = F.coalesce(F.when(average != "", average), real if real is not None else F.lit(None), F.lit("0/1"))
    parts = F.split(text, "/")
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.coalesce(F.when(F.contains(text, F.lit("/")), F.try_divide(a, F.nullif(b, F.lit(0.0)))).otherwise(text.try_cast("double")), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def complexity(width: Column, height: Column, seconds: Column) -> Column:
    """Pixels and time against one minute of 1920 x 1080, at least 1."""
    w, h, s = F.coalesce(width, F.lit(1920)), F.coalesce(height, F.lit(1080)), F.coalesce(seconds, F.lit(0.0))
    return F.greatest(F.lit(1.0), (w.cast("double") * h * s) / F.lit(1920.0 * 1080 * 60))


def progress_text(line: Column) -> Column:
    """``time=H:M:S.f`` in a log line as ``Processing: HH:MM:SS.ff``; null without it."""
    part = lambda i: F.regexp_extract(line, r"time=(\d+):(\d+):(\d+\.?\d*)", i)
    return F.when(part(1) != "", F.format_string("Processing: %02d:%02d:%05.2f", part(1).cast("int"), part(2).cast("int"), part(3).cast("double")))


def even(x: Column) -> Column:
    return x + F.abs(x % 2)


def target_size(width: Column, height: Column, target_w: Column, target_h: Column, keep_aspect: bool = True) -> Column:
    """struct(w, h): fits the box, turned to the input's orientation, whole and even; without a target the input."""
    if keep_aspect:
        box_w = F.when(height > width, target_h).when(width > height, target_w).otherwise(F.least(target_w, target_h))
        box_h = F.when(height > width, target_w).when(width > height, target_h).otherwise(F.least(target_w, target_h))
        scale = F.least(F.when(width > 0, box_w / width).otherwise(1.0), F.when(height > 0, box_h / height).otherwise(1.0))
        w, h = even((width * scale).cast("int")), even((height * scale).cast("int"))
    else:
        w, h = even(target_w), even(target_h)
    none = target_w.isNull() | target_h.isNull()
    return F.struct(F.when(none, width).otherwise(w).cast("int").alias("w"), F.when(none, height).otherwise(h).cast("int").alias("h"))


def upscale_passes(scale: Column, per_pass: float = 4.0) -> Column:
    """Passes of at most ``per_pass`` that reach a scale, at least one."""
    return F.when(scale > 1, F.ceil(F.log(scale) / F.log(F.lit(per_pass)))).otherwise(1).cast("int")


def last_pass_scale(scale: Column) -> Column:
    """The power of two nearest to the scale (halves of the exponent to even); 2 up to scale 1."""
    return F.when(scale > 1, F.pow(F.lit(2.0), F.bround(F.log2(scale), 0))).otherwise(2.0)


def upscale_method(width: Column, target_w: Column, use_ai: Column | None = None, method: Column | None = None) -> Column:
    """A global choice first, then the given method, then ai if the input is narrower than the target."""
    own = F.coalesce(*( [method] if method is not None else [] ), F.when(width < target_w, "ai").otherwise("traditional"))
    return own if use_ai is None else F.when(use_ai, "ai").when(~use_ai, "traditional").otherwise(own)


def interpolation_factor(current: Column, target: Column, ai: bool = False) -> Column:
    factor = F.coalesce(F.try_divide(target, F.nullif(current, F.lit(0.0))).cast("int"), F.lit(2))
    return F.greatest(F.lit(2), factor) if ai else factor


def zoom_percent(move: Column, width: Column, height: Column) -> Column:
    """0 below the threshold, else a share of the movement, never below the limit."""
    share = -(move / F.least(width, height)) * 100.0 * T.ZOOM_GAIN
    return F.when(move < T.ZOOM_THRESHOLD, 0.0).otherwise(F.greatest(F.lit(-T.ZOOM_LIMIT), F.least(F.lit(0.0), share)))


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """A small literal map with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def fourcc(codec: Column) -> Column:
    return lookup(codec, T.FOURCC, "H264")


def denoise_strengths(strength: Column) -> Column:
    """The four filter strengths, joined by colons."""
    table = {k: ":".join(map(str, v)) for k, v in T.DENOISE.items()}
    return lookup(strength, table, table["medium"])


def quality_score(mode: Column, vmaf: Column, least: Column, mean: Column, greatest: Column) -> Column:
    return F.when(mode == "min", F.coalesce(least, vmaf)).when(mode == "avg", F.coalesce(mean, vmaf)).when(mode == "max", F.coalesce(greatest, vmaf)).otherwise(vmaf)


def meets_target(mode: Column, score: Column, target: Column) -> Column:
    return F.when(mode == "none", True).otherwise(score >= target)


def one_decimal(x: Column) -> Column:
    """A number with one decimal as C and Python print it: the double's exact value is rounded, exact ties to even.

    Twenty times the value is taken in two exact parts, so the side of a tie is known.
    """
    a = F.abs(x.cast("double"))
    k = F.floor(a * 10)
    high = a.cast("float").cast("double")
    side = (high * 20 - (2 * k + 1)) + (a - high) * 20
    tenths = (k + F.when((side > 0) | ((side == 0) & (k % 2 == 1)), 1).otherwise(0)).cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def loss_verdict(original: Column, new: Column, mode: Column, score: Column, max_loss: float = 5.0) -> Column:
    """struct(acceptable, reason) for a size reduction at a quality score; a null mode means no quality."""
    smaller = (original - new) / F.nullif(original, F.lit(0)) * 100
    loss = 100.0 - score
    unchecked = mode.isNull() | (mode == "none")
    acceptable = F.when(original == 0, False).when(unchecked, True).otherwise(loss <= max_loss)
    reason = (
        F.when(original == 0, "Original size is zero")
        .when(unchecked, F.concat(F.lit("Size reduced by "), one_decimal(smaller), F.lit("% (no quality check)")))
        .when(loss > max_loss, F.concat(F.lit("Quality loss "), one_decimal(loss), F.lit(f"% exceeds max {max_loss}%")))
        .otherwise(F.concat(F.lit("Quality loss "), one_decimal(loss), F.lit("% within limit, size reduced "), one_decimal(smaller), F.lit("%")))
    )
    return F.struct(acceptable.alias("acceptable"), reason.alias("reason"))


def resolve_acceleration(preferred: Column, available: Column) -> Column:
    """The wish if it is available; for auto the first available of a fixed order; else none."""
    first = F.get(F.filter(F.array(*map(F.lit, T.ACCELERATIONS)), lambda x: F.array_contains(available, x)), F.lit(0))
    own = F.when(F.array_contains(available, F.lower(preferred)), F.lower(preferred))
    return F.when(preferred == "none", "none").when(preferred == "auto", F.coalesce(first, F.lit("none"))).otherwise(F.coalesce(own, F.lit("none")))


def device(preferred: Column, available: Column) -> Column:
    """The device for models: for auto the first available of a fixed order, else the wish if it is available, else the CPU."""
    has = lambda name: F.coalesce(F.array_contains(available, name), F.lit(False))
    own = F.when(preferred.isin(*T.DEVICES) & has(preferred), preferred)
    first = F.coalesce(*[F.when(has(d), d) for d in T.DEVICES])
    return F.coalesce(F.when(preferred == "auto", first).otherwise(own), F.lit("cpu"))


def dtype(preferred: Column) -> Column:
    return lookup(preferred, T.DTYPES, "float32")


def acceleration_arguments(acceleration: Column) -> Column:
    return F.when(acceleration == "none", F.array().cast("array<string>")).otherwise(F.array(F.lit("-hwaccel"), acceleration))


def shortened(error: Column, stage: Column) -> Column:
    """An error's text, cut as its stage cuts it."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in T.ERROR_LENGTHS.items() for x in kv]), stage), F.length(error))
    return F.substring(error, F.lit(1), limit)


def encode_arguments(source: Column, target: Column, codec: Column, acceleration: Column, preset: Column, crf: Column, audio: Column, bitrate: Column, filters: Column | None = None) -> Column:
    """The arguments of an encoding command."""
    flags = F.array(F.lit("-i"), source, F.lit("-c:v"), encoder(codec, acceleration), F.lit("-preset"), preset, F.lit("-crf"), crf.cast("string"), F.lit("-c:a"), audio, F.lit("-b:a"), bitrate)
    chain = F.array().cast("array<string>") if filters is None else F.when(F.coalesce(filters, F.lit("")) != "", F.array(F.lit("-vf"), filters)).otherwise(F.array().cast("array<string>"))
    return F.concat(acceleration_arguments(acceleration), flags, chain, F.array(F.lit("-y"), F.coalesce(target, source)))


def encoder(codec: Column, acceleration: Column) -> Column:
    table = {f"{c}|{a}": h for c, own in T.HARDWARE_CODECS.items() for a, h in own.items()}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.concat_ws("|", codec, acceleration)), codec)


def extension(path: Column) -> Column:
    """The last extension of a path's name, lower case, with its dot; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def output_path(path: Column, folder: Column | None = None) -> Column:
    """``<folder>/<stem>_enhanced<ext>``; the input's folder if none is given."""
    ext = F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1)
    name = base_name(path)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.concat(F.coalesce(folder, directory(path)) if folder is not None else directory(path), F.lit("/"), stem, F.lit("_enhanced"), ext)


def feature_flags(names: Column) -> Column:
    """``a, b`` as ``a=1:b=1``."""
    return F.array_join(F.transform(F.split(names, ","), lambda x: F.concat(F.trim(x), F.lit("=1"))), ":")


def status_icon(status: Column) -> Column:
    return lookup(status, {"completed": "OK", "skipped": "SKIP", "failed": "FAIL"}, "?")
