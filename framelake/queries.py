"""One query for each operator group, over the views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plugins, ship
from . import views as V
from .functions import scalar as S
from .functions import tables as T
from .operators import audio, fingerprint, motion, pixels, quality, sequence
from .plans import analyze, planner, runner
from .sources import config, files, logs, probe

DAY = 86400.0
TARGET = (1920, 1080)


def classify_files(s, d):
    return files.classify(V.files(s, d)).select("path", "ext", "is_video", "is_image")


def scan_directory_recursive(s, d):
    return files.scan(V.files(s, d), "/lib", True).select("dir", "name", "path", "ord")


def scan_directory_flat(s, d):
    return files.scan(V.files(s, d), "/lib/Brand#11", False).select("dir", "name", "path", "ord")


def add_files(s, d):
    return files.expand(V.files(s, d), ["/lib/Brand#11", "/lib/Brand#12"], ["/lib/none.mp4"]).select("path", S.output_path(F.col("path")).alias("output_path"))


def _media(s, d):
    return probe.parse_probe(V.probes(s, d))


def probe_parse_streams(s, d):
    x = _media(s, d).select("media_id", F.explode("streams").alias("s"))
    return x.select("media_id", F.col("s.index").alias("stream_index"), "s.codec_type", "s.codec_name", "s.width", "s.height", "s.fps", "s.bit_rate", "s.color_transfer")


def media_info(s, d):
    x = probe.media_info(_media(s, d))
    return x.select("media_id", "duration", "format_name", "width", "height", "framerate", "has_video", "has_audio", "is_hdr", "video_codec", F.array_join("audio_codecs", ",").alias("audio_codecs"), "n_audio", "n_streams")


def detect_needs(s, d):
    return probe.needs(probe.media_info(_media(s, d))).select("media_id", F.array_join("needs_processing", ",").alias("needs_processing"), "shake_detected")


def frame_rate_parse(s, d):
    return V.streams(s, d).select("media_id", "idx", S.frame_rate(F.col("rate")).alias("fps"))


def frame_sampling_even(s, d):
    return sequence.sample_even(V.indexed_frames(s, d), "video", "idx").select("video", "idx", "event_id")


def frame_sampling_interval(s, d):
    return sequence.sample_interval(V.indexed_frames(s, d), "idx", 2.5, 2.0).select("video", "idx", "event_id")


def frame_extract(s, d):
    return sequence.extract(V.indexed_frames(s, d), "video", "idx", 2.0, 5.0, 20.0, 100).select("video", "idx", "event_id")


def frame_pairs(s, d):
    x = sequence.pairs(V.indexed_frames(s, d), "video", "idx", ["event_id"], 3)
    return x.select("video", "idx", "event_id", F.col("prev.event_id").alias("prev_event_id"))


def frame_scores(s, d):
    x = sequence.difference_scores(V.frames(s, d), "video", ["us", "event_id"], "luma", F.floor(F.col("t") / DAY))
    return x.select("video", "event_id", "t", "score")


def scene_segments(s, d):
    block = F.floor(F.col("t") / DAY)
    scored = sequence.difference_scores(V.frames(s, d), "video", ["us", "event_id"], "luma", block)
    return sequence.scene_segments(scored, shortest=7200.0, block=block)


def correlation_cuts(s, d):
    x = sequence.previous(V.thumbnails(s, d), "video", ["frame"], ["frame", "pixels"], F.floor(F.col("frame") / 10_000))
    scored = x.where("prev IS NOT NULL").select("video", "frame", F.round(sequence.correlation(F.col("prev.pixels"), F.col("pixels")), 8).alias("corr"))
    return scored.where(F.col("corr") < T.CORRELATION_CUT)


def pixel_difference(s, d):
    x = sequence.previous(V.thumbnails(s, d), "video", ["frame"], ["pixels"], F.floor(F.col("frame") / 10_000))
    return x.where("prev IS NOT NULL").select("video", "frame", F.round(sequence.frame_difference(F.col("prev.pixels"), F.col("pixels")), 10).alias("score"))


def video_fingerprint(s, d):
    return fingerprint.fingerprints(V.thumbnails(s, d))


def _prints(s, d):
    return V.thumbnails(s, d).select(F.col("frame").alias("video"), fingerprint.frame_bits(F.col("pixels")).alias("bits"))


def find_similar(s, d):
    x = fingerprint.ranked(fingerprint.find_similar(_prints(s, d), "0", threshold=0.55))
    return x.select("video", F.round("similarity", 8).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def near_duplicate_pairs(s, d):
    x = fingerprint.near_pairs(_prints(s, d), threshold=0.70)
    return x.select("a", "b", F.round("similarity", 8).alias("similarity"))


def shake_analysis(s, d):
    x = motion.shake(V.vectors(s, d))
    return x.select("video", F.round("avg_motion", 8).alias("avg_motion"), F.round("max_motion", 8).alias("max_motion"), F.round("significant", 8).alias("significant"), "needs_stabilization")


def motion_outliers(s, d):
    return motion.outlier_frames(V.vectors(s, d)).select("video", "frame", F.round("motion", 8).alias("motion"), F.round("limit", 8).alias("motion_limit"))


def motion_cleaned(s, d):
    x = motion.cleaned(V.vectors(s, d))
    return x.groupBy("video").agg(F.count_if("was_outlier").alias("n_cleaned"), F.sum("dx").alias("sum_dx"), F.sum("dy").alias("sum_dy"), F.count("*").alias("n"))


def zoom_estimate(s, d):
    x = motion.zoom(V.vectors(s, d, 60), 1920, 1080)
    return x.select("video", "movement", F.round("zoom", 8).alias("zoom"))


def trf_text_parse(s, d):
    v = V.vectors(s, d)
    one = F.concat(F.lit("(LM "), F.col("dx").cast("string"), F.lit(" "), F.col("dy").cast("string"), F.lit(" 16 16 32 0.5 1.0)"))
    lines = v.groupBy("video", "frame").agg(F.array_sort(F.collect_list(one)).alias("l")).select("video", "frame", F.concat(F.lit("Frame "), F.col("frame").cast("string"), F.lit(" (List "), F.size("l").cast("string"), F.lit(" ["), F.array_join("l", ","), F.lit("])")).alias("line"))
    return logs.motion_vectors(lines).groupBy("video").agg(F.count("*").alias("n"), F.sum("dx").alias("sum_dx"), F.sum("dy").alias("sum_dy"))


def quality_pairs(s, d):
    x = V.thumbnails(s, d)
    ref = x.where("frame % 2 = 0").select((F.col("frame") / 2).cast("long").alias("pair"), "pixels")
    dist = x.where("frame % 2 = 1").select(((F.col("frame") - 1) / 2).cast("long").alias("pair"), "pixels")
    q = quality.compare(ref, dist, ["pair"])
    return q.select("pair", F.round("mse", 6).alias("mse"), F.round("psnr", 6).alias("psnr"), F.round("ssim", 6).alias("ssim"))


def _log_text():
    v = F.col("value").cast("string")
    per = F.concat(F.lit("PSNR_y: "), v, F.lit(" PSNR_y: "), (F.col("event_id") % 50).cast("string"), F.lit(".5"))
    return F.concat(per, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\nPSNR average: "), v)).otherwise(""), F.lit("\nSSIM x = 0.5"))


def quality_log_parse(s, d):
    x = V.table(s, d, "events").withColumn("line", _log_text())
    m = logs.summary_metrics(F.col("line"), "PSNR")
    return x.select("event_id", *[F.round(c, 6).alias(n) for n, c in m.items()], logs.line_metrics(F.col("line"))["ssim"].alias("ssim_line"))


def vmaf_json_parse(s, d):
    v = F.col("value").cast("string")
    obj = F.concat(F.lit('{"mean": '), v, F.lit(', "min": 1.5, "vmaf": 7.0}'))
    lst = F.concat(F.lit('[{"vmaf": '), v, F.lit('}, {"vmaf": 10.0}, {"other": 1}]'))
    text = F.when(F.col("event_id") % 4 == 0, obj).when(F.col("event_id") % 4 == 1, lst).when(F.col("event_id") % 4 == 2, "[]").otherwise("not json")
    x = V.table(s, d, "events").withColumn("line", text)
    return x.select("event_id", *[F.round(c, 6).alias(n) for n, c in logs.vmaf(F.col("line")).items()])


def _modes():
    return F.element_at(F.array(*map(F.lit, ("none", "target", "min", "avg", "max"))), (F.col("l_suppkey") % 5 + 1).cast("int"))


def quality_score_mode(s, d):
    x = V.table(s, d, "lineitem").withColumn("mode", _modes())
    score = S.quality_score(F.col("mode"), F.col("l_quantity") * 2, F.col("l_quantity"), F.col("l_quantity") * 2 + 0.5, F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity") * 2 + 1))
    y = x.withColumn("score", score).withColumn("meets", S.meets_target(F.col("mode"), F.col("score"), F.lit(60.0)))
    return y.groupBy("l_orderkey", "mode").agg(F.sum("score").alias("score"), F.count_if("meets").alias("n_meets"))


def quality_loss_verdict(s, d):
    x = V.table(s, d, "lineitem").withColumn("mode", F.when(F.col("l_partkey") % 7 == 0, F.lit(None)).otherwise(_modes()))
    original = F.when(F.col("l_partkey") % 11 == 0, 0).otherwise(F.col("l_partkey") * 1000)
    v = S.loss_verdict(original, F.col("l_partkey") * 500 + F.col("l_suppkey"), F.col("mode"), F.col("l_quantity") + 50, 25.0)
    return x.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", v.alias("v")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "v.acceptable", "v.reason")


def target_dimensions(s, d):
    x = V.streams(s, d).where("codec_type = 'video'").withColumn("w", F.when(F.col("idx") % 3 == 0, F.col("height")).otherwise(F.col("width"))).withColumn("h", F.when(F.col("idx") % 3 == 0, F.col("width")).when(F.col("idx") % 3 == 1, F.col("width")).otherwise(F.col("height")))
    t = S.target_size(F.col("w"), F.col("h"), F.lit(3840), F.lit(2160))
    return x.select("media_id", "idx", t.alias("t")).select("media_id", "idx", F.col("t.w").alias("target_w"), F.col("t.h").alias("target_h"))


def upscale_passes(s, d):
    x = V.streams(s, d).where("codec_type = 'video'").withColumn("scale", F.greatest(3840.0 / F.col("width"), 2160.0 / F.col("height")))
    return x.select("media_id", "idx", S.upscale_passes(F.col("scale")).alias("passes"), S.last_pass_scale(F.col("scale")).alias("last_scale"), S.upscale_method(F.col("width"), F.lit(1920)).alias("method"), S.interpolation_factor(S.frame_rate(F.col("rate")), F.lit(60.0)).alias("factor"))


def _planned(s, d):
    return planner.plan_stages(probe.media_info(_media(s, d)), TARGET, 60.0, dict(T.DEFAULT_CONFIG) | {"stages.hdr_to_sdr.enabled": "true"})


def plan_stages(s, d):
    return _planned(s, d).select("media_id", F.array_join("stages", ",").alias("stages"))


def order_stages(s, d):
    req = V.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.array(*map(F.lit, ("encode", "upscale", "stabilize", "denoise_video")))).otherwise(F.array(*map(F.lit, ("remux", "encode", "foo", "remux")))).alias("r"))
    return req.select("o_orderkey", F.array_join(planner.ordered(F.col("r")), ",").alias("stages"))


def should_run_matrix(s, d):
    return planner.stage_matrix(_planned(s, d), "media_id", TARGET, dict(T.DEFAULT_CONFIG) | {"stages.hdr_to_sdr.enabled": "true"}).select("media_id", "ord", "stage", "run", F.coalesce("reason", F.lit("")).alias("reason"))


def job_schedule(s, d):
    return planner.schedule(V.jobs(s, d)).select("job_id", "priority", F.col("position").cast("long").alias("position"))


def job_rollup(s, d):
    return runner.rollup(V.stage_results(s, d)).select("job_id", "n_stages", "n_errors", "n_skipped", "total_duration", "errors", "skipped", "success", "status", "output_path")


def job_rollup_stop(s, d):
    return runner.rollup(V.stage_results(s, d), stop_on_error=True).select("job_id", "n_stages", "n_errors", "success", "output_path")


def job_input_chain(s, d):
    return runner.input_chain(V.stage_results(s, d)).select("job_id", "ord", "stage_input")


def run_summary(s, d):
    return runner.summary(runner.rollup(V.stage_results(s, d)))


def job_report(s, d):
    return runner.report(V.stage_results(s, d))


OVERRIDES = [("general.max_concurrent_jobs", "10"), ("general.new_key", "new_value"), ("quality.quality_target.target", None)]


def config_merge(s, d):
    return config.merge(config.config_table(s, list(T.DEFAULT_CONFIG)), config.config_table(s, OVERRIDES))


def preset_config(s, d):
    return config.preset_config(config.presets(s))


def encoder_select(s, d):
    o = V.table(s, d, "orders").withColumn("codec", V.pick(("libx264", "libx265", "libvpx-vp9", "copy"), F.col("o_custkey")))
    have = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("vaapi"), F.lit("cuda"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("qsv"))).otherwise(F.array().cast("array<string>"))
    wish = V.pick(("auto", "none", "QSV", "vulkan"), F.col("o_custkey") + F.col("o_orderkey"))
    x = o.withColumn("acceleration", S.resolve_acceleration(wish, have))
    return x.select("o_orderkey", "acceleration", S.encoder(F.col("codec"), F.col("acceleration")).alias("encoder"), F.array_join(S.acceleration_arguments(F.col("acceleration")), " ").alias("arguments"), S.fourcc(F.col("codec")).alias("fourcc"))


def loudness_parse(s, d):
    v = F.col("value").cast("string")
    body = F.concat(F.lit('log {\n"input_i" : "-'), v, F.lit('", "input_tp" : "-1.5", "input_lra" : "'), (F.col("event_id") % 20).cast("string"), F.lit('"\n} end'))
    x = V.table(s, d, "events").withColumn("line", F.when(F.col("event_id") % 5 == 0, "no json here").otherwise(body))
    return x.select("event_id", *[c.alias(n) for n, c in logs.loudness(F.col("line")).items()])


def loudness_two_pass(s, d):
    x = V.frames(s, d).withColumn("sample", F.col("luma") / 500.0)
    return audio.normalise(x, "video", "sample").select("event_id", F.round("gain_db", 6).alias("gain_db"), F.round("normalised", 6).alias("normalised"))


def speed_retime(s, d):
    return sequence.retime(V.frames(s, d), "t", 1.5).select("video", "event_id", F.round("t", 6).alias("t"))


def frame_interpolate(s, d):
    x = sequence.interpolate(V.indexed_frames(s, d), "video", "idx", "luma", 3)
    return x.select("video", "pos", F.round("value", 6).alias("value"))


def temporal_denoise(s, d):
    return sequence.temporal_denoise(V.indexed_frames(s, d), "video", "idx", "luma").select("video", "idx", F.round("smooth", 6).alias("smooth"))


def progress_parse(s, d):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, "frame=1").otherwise(F.concat(F.lit("frame=1 time="), F.lpad((e % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((e % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((e % 59).cast("string"), 2, "0"), F.lit(".25 speed=1x")))
    return logs.progress(V.table(s, d, "events").withColumn("line", text)).select("event_id", "message", S.clamp(F.col("value") / 400.0).alias("progress"))


def complexity(s, d):
    i = probe.media_info(_media(s, d))
    return i.select("media_id", S.complexity(F.col("width"), F.col("height"), F.col("duration")).alias("complexity"))


def file_checksums(s, d):
    return files.checksums(V.table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", "sha256")


def model_inventory(s, d):
    return files.model_inventory(files.models(s), V.model_files(s, d))


def upscale_pixels(s, d):
    x = pixels.upscale_grid(V.thumbnails(s, d), "pixels", 8, 8, 2)
    return x.select("frame", F.size("upscaled").alias("n"), F.round(F.aggregate("upscaled", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"), F.round(F.get("upscaled", F.lit(37)).cast("double"), 6).alias("p37"))


def tonemap_pixels(s, d):
    x = V.table(s, d, "events").select("event_id", pixels.tone_map(F.col("value") / 50.0).alias("m"))
    return x.select("event_id", F.round("m", 8).alias("mapped"))


def tta_average(s, d):
    x = pixels.map_grids(V.thumbnails(s, d), "frame", "pixels", 8, 8, lambda g: pixels.augmented_mean(lambda i: i * 2.0, g))
    return x.select("frame", F.size("pixels").alias("n"), F.round(F.get("pixels", F.lit(9)), 6).alias("p9"))


def video_analysis(s, d):
    x = V.frames(s, d).groupBy("video").agg(F.count("*").alias("n_frames"), F.max("t").alias("duration"))
    y = analyze.analyse(x, scene_segments(s, d))
    return y.select("video", "n_frames", "duration", "total_scenes", F.round("scene_seconds", 4).alias("scene_seconds"), F.size("scenes").alias("n_listed"), F.get("scenes", F.lit(0))["end_time"].alias("first_end"))


def first_scenes(s, d):
    return sequence.first_scenes(scene_segments(s, d))


def sample_seconds(s, d):
    return sequence.sample_seconds(V.indexed_frames(s, d).withColumn("t", F.col("t") / 3600.0), "video", "idx", "t")


def stage_progress(s, d):
    x = V.stage_results(s, d).withColumn("part", F.col("duration_sec") / 40.0)
    return runner.progress(x, part="part").select("job_id", "ord", "is_last", F.round("overall", 8).alias("overall"))


def job_sizes(s, d):
    x = V.table(s, d, "part").select(F.col("p_partkey").alias("job_id"), (F.col("p_size") * 10 * (F.col("p_partkey") % 4)).alias("input_size"), F.col("p_retailprice").alias("output_size"))
    return runner.size_ratio(x).select("job_id", F.round("size_ratio", 8).alias("size_ratio"))


def job_status(s, d):
    jobs = runner.rollup(V.stage_results(s, d)).withColumn("cancel", F.col("job_id") % 10 == 0)
    return runner.final_status(jobs, "cancel").groupBy("status").agg(F.count("*").alias("n"))


def model_paths(s, d):
    return files.model_paths(files.models(s), V.model_files(s, d))


def stage_parameters(s, d):
    wish = V.pick(("low", "medium", "high", "extreme"), F.col("event_id"))
    return V.table(s, d, "events").select("event_id", S.denoise_strengths(wish).alias("denoise"), S.feature_flags(F.concat(wish, F.lit(", ssim"))).alias("flags"), S.status_icon(V.pick(("completed", "skipped", "failed"), F.col("event_id"))).alias("icon"))


def ssim_log_parse(s, d):
    v = F.col("event_id") % 100 / 100.0
    line = F.concat(F.lit("SSIM_y: "), v.cast("string"), F.lit(" SSIM_y: 0.5 SSIM_y: 0.75"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\nSSIM average: "), ((F.col("event_id") % 7) / 8.0).cast("string"))).otherwise(""))
    x = V.table(s, d, "events").withColumn("line", line)
    return x.select("event_id", *[F.round(c, 6).alias(n) for n, c in logs.summary_metrics(F.col("line"), "SSIM").items()])


USER_CONFIG = [("general.log_level", "DEBUG"), ("quality.quality_target", "off"), ("encoding.crf", "30"), ("stages.speed.enabled.forced", "yes")]


def config_layers(s, d):
    over = config.preset_config(config.preset(config.presets(s), "4k60")).select("path", "value")
    return config.layered([("default", config.config_table(s, list(T.DEFAULT_CONFIG))), ("user", config.config_table(s, USER_CONFIG)), ("preset", over)])


def stage_overrides(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderkey").alias("job_id"), V.pick(T.STAGE_ORDER, F.col("o_custkey")).alias("stage"), F.create_map(F.lit("factor"), (F.col("o_custkey") % 4).cast("string"), F.lit("strength"), F.lit("high")).alias("options"))
    x = runner.with_overrides(V.stage_results(s, d), o)
    return x.select("job_id", "ord", "stage", F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("options"))


def queue_run(s, d):
    jobs = planner.schedule(V.jobs(s, d))
    raised = V.jobs(s, d).where("job_id % 13 = 0").select("job_id", F.concat(F.lit("no such input: "), F.col("job_id").cast("string")).alias("error"))
    x = runner.execute_all(jobs, V.stage_results(s, d), raised, cancelled_from=1200)
    return x.select("job_id", F.col("position").cast("long").alias("position"), "success", "errors", "told")


def encode_commands(s, d):
    x = V.table(s, d, "orders").withColumn("codec", V.pick(("libx264", "libx265", "libvpx-vp9", "copy"), F.col("o_custkey"))).withColumn("a", V.pick(("none", "cuda", "qsv"), F.col("o_orderkey")))
    key = F.col("o_orderkey").cast("string")
    args = S.encode_arguments(F.concat(F.lit("/in/"), key), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/out/"), key)), F.col("codec"), F.col("a"), F.lit("medium"), F.col("o_custkey") % 30, F.lit("aac"), F.lit("192k"), F.when(F.col("o_orderkey") % 5 == 0, "hqdn3d=4:3:6:6"))
    return x.select("o_orderkey", F.array_join(args, " ").alias("arguments"))


def error_texts(s, d):
    x = V.table(s, d, "events").withColumn("stage", V.pick(("encode", "upscale", "denoise_video", "hdr"), F.col("event_id")))
    return x.select("event_id", "stage", S.shortened(F.repeat(F.concat(F.lit("failed: "), F.col("event_id").cast("string"), F.lit("; ")), 150), F.col("stage")).alias("error"))


def file_fallbacks(s, d):
    info = probe.media_info(probe.parse_probe(V.probes(s, d).withColumn("probe", F.when(F.col("media_id") % 3 == 0, "not json").otherwise(F.col("probe")))))
    x = files.with_fallbacks(info.select("media_id", F.when(F.col("media_id") % 3 != 0, F.col("duration")).alias("duration"), F.when(F.col("media_id") % 2 == 0, F.col("media_id") * 1000).alias("size_bytes")))
    return x.select("media_id", "duration", F.col("size_bytes").cast("long").alias("size_bytes"))


def model_cache_clear(s, d):
    return files.cached_removals(files.models(s), V.model_files(s, d).where("path LIKE '/cache/%'"))


def stabilise_scene_counts(s, d):
    return analyze.scene_counts(V.thumbnails(s, d).select("video").distinct(), correlation_cuts(s, d))


def stabilise_shifts(s, d):
    x = motion.stabilise(V.vectors(s, d), reach=2)
    return x.select("video", "frame", F.round("shift_x", 6).alias("shift_x"), F.round("shift_y", 6).alias("shift_y"))


def spatial_denoise(s, d):
    x = V.thumbnails(s, d).select("frame", pixels.spatial_denoise(F.col("pixels"), 8, 8).alias("p"))
    return x.select("frame", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in (0, 9, 63)], F.round(F.aggregate("p", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


def deblock_frames(s, d):
    return pixels.deblock(V.thumbnails(s, d)).select("frame", "method", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"))


def _repeat_model():
    import numpy as np

    return lambda images, scale: np.repeat(np.repeat(images, scale, axis=1), scale, axis=2)


def upscale_chain(s, d):
    ship(s)
    x = pixels.map_model(V.thumbnails(s, d), "frame", "pixels", 8, 8, "repeat", _repeat_model, scale=8)
    return x.select("frame", F.size("pixels").alias("n"), F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v), 3).alias("total"), F.round(F.get("pixels", F.lit(1000)), 6).alias("p1000"))


def plugin_chain(s, d):
    plugins.register_columns("brighten", lambda: F.col("luma") < 100)(lambda: {"luma": F.col("luma") * 1.5})
    plugins.register_columns("mark_dark", lambda: F.col("luma") < 50)(lambda: {"dark": F.lit(True)})
    x, _ = plugins.run_chain(V.frames(s, d), ["brighten", "unknown", "mark_dark"])
    return x.select("event_id", F.round("luma", 6).alias("luma"), F.coalesce("dark", F.lit(False)).alias("dark"))


def _brightness_tags(batch):
    import pandas as pd

    tags = [["bright"] if x > 150 else ["dark", "low"] if x < 50 else [] for x in batch["luma"]]
    return pd.DataFrame({"event_id": batch["event_id"], "summary": [f"{len(t)} tags" for t in tags], "tags": tags})


def frame_tags(s, d):
    ship(s)
    plugins.TAGGERS["brightness"] = _brightness_tags
    x = plugins.tag_frames(V.frames(s, d).select("event_id", "luma"), "brightness", key="event_id")
    return x.select("event_id", "summary", F.array_join("tags", ",").alias("tags"))


def model_devices(s, d):
    o = V.table(s, d, "orders").withColumn("wish", V.pick(("auto", "cuda", "mps", "cpu", "tpu"), F.col("o_custkey"))).withColumn("kind", V.pick(("fp16", "fp32", "bf16", "int8"), F.col("o_orderkey")))
    have = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("mps"), F.lit("cuda"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("mps"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", S.device(F.col("wish"), have).alias("device"), S.dtype(F.col("kind")).alias("dtype"))


def queued_jobs(s, d):
    o = V.table(s, d, "orders").withColumn("status", V.pick(("idle", "running", "completed", "queued"), F.col("o_custkey")))
    return o.select("o_orderkey", runner.is_queued(F.when(F.col("o_orderkey") % 7 != 0, F.col("status"))).alias("is_queued"))


def frame_times(s, d):
    x = V.indexed_frames(s, d)
    times = x.where("video % 3 <> 0 AND idx < 8").select("video", "idx", "t")
    return sequence.with_times(x.select("video", "idx", "event_id"), times, "video", "idx").select("video", "idx", "event_id", F.round("t", 6).alias("t"))


def named_preset(s, d):
    return config.preset_config(config.preset(config.presets(s), "4k60"))


ALL = (
    model_devices, queued_jobs, frame_times, named_preset,
    ssim_log_parse, config_layers, stage_overrides, queue_run, encode_commands, error_texts, file_fallbacks, model_cache_clear,
    stabilise_scene_counts, stabilise_shifts, spatial_denoise, deblock_frames, upscale_chain, plugin_chain, frame_tags,
    video_analysis, first_scenes, sample_seconds, stage_progress, job_sizes, job_status, model_paths, stage_parameters,
    classify_files, scan_directory_recursive, scan_directory_flat, add_files, probe_parse_streams, media_info, detect_needs, frame_rate_parse,
    frame_sampling_even, frame_sampling_interval, frame_extract, frame_pairs, frame_scores, scene_segments, correlation_cuts, pixel_difference,
    video_fingerprint, find_similar, near_duplicate_pairs, shake_analysis, motion_outliers, motion_cleaned, zoom_estimate, trf_text_parse,
    quality_pairs, quality_log_parse, vmaf_json_parse, quality_score_mode, quality_loss_verdict, target_dimensions, upscale_passes,
    plan_stages, order_stages, should_run_matrix, job_schedule, job_rollup, job_rollup_stop, job_input_chain, run_summary, job_report,
    config_merge, preset_config, encoder_select, loudness_parse, loudness_two_pass, speed_retime, frame_interpolate, temporal_denoise,
    progress_parse, complexity, file_checksums, model_inventory, upscale_pixels, tonemap_pixels, tta_average,
)


def tta_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tta_average(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL} | {"tta_average": tta_shipped}
