"""Hand-computed cases and invariance of the operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake import plugins
from framelake.functions import scalar as S
from framelake.functions import tables as T
from framelake.operators import fingerprint, motion, pixels, sequence
from framelake.plans import planner, runner
from framelake.sources import config, files, logs, probe


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def scenes(spark, luma, fps=1.0, block=1e6, threshold=T.SCENE_THRESHOLD):
    rows = spark.createDataFrame([("v", i, i / fps, float(x)) for i, x in enumerate(luma)], "video string, idx long, t double, luma double")
    scored = sequence.difference_scores(rows, "video", ["idx"], "luma", F.floor(F.col("t") / block))
    found = sequence.scene_segments(scored, threshold=threshold, block=F.floor(F.col("t") / block))
    return sorted((r.start_time, r.end_time, round(r.confidence, 4)) for r in found.collect())


@pytest.mark.parametrize("block", [1e6, 2.0, 1.0])
@pytest.mark.parametrize(("luma", "want"), [
    ([0, 0, 0, 255, 255, 0, 0, 0, 0], [(0, 3, 1.0), (3, 5, 1.0), (5, 8, 0.5)]),
    ([0, 0, 0, 255, 0, 0, 0], [(0, 3, 1.0), (4, 6, 0.5)]),
    ([9], []),
    ([7, 7], [(0, 1, 0.5)]),
    ([0, 0, 76, 76], [(0, 3, 0.5)]),
    ([0, 0, 77, 77], [(0, 2, 0.302), (2, 3, 0.5)]),
])
def test_scenes(spark, luma, want, block):
    assert scenes(spark, luma, block=block) == want


def test_scenes_do_not_depend_on_partitions_or_blocks(spark):
    rng = np.random.default_rng(3)
    luma = rng.integers(0, 256, 300).tolist()
    assert scenes(spark, luma, block=1e6) == scenes(spark, luma, block=7.0) == scenes(spark, luma, block=64.0)


def test_fingerprints(spark):
    rows = [("a", [10, 20, 30, 40]), ("a", [40, 30, 20, 10]), ("a", [0, 0, 100, 100]), ("b", [10, 20, 30, 40]), ("b", [40, 30, 20, 10]), ("c", [7, 7, 7, 7])]
    x = fingerprint.fingerprints(spark.createDataFrame(rows, "video string, pixels array<int>"))
    assert {r.video: (r.bits, r.n_frames) for r in x.collect()} == {"a": ("0011", 3), "b": ("0000", 2), "c": ("0000", 1)}


@pytest.mark.parametrize(("a", "b", "want"), [("0011", "0111", 0.75), ("", "0", 0.0), ("01", "011", 0.0), ("", "", 0.0)])
def test_similarity(spark, a, b, want):
    assert one(spark, fingerprint.similarity(F.lit(a), F.lit(b))) == want


def test_near_pairs_find_all(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (6, 64))
    prints = [base[i % 6] ^ (rng.random(64) < 0.08) for i in range(60)] + [base[0]]
    text = ["".join(map(str, p.astype(int))) for p in prints]
    got = {(r.a, r.b) for r in fingerprint.near_pairs(spark.createDataFrame(list(enumerate(text)), "video long, bits string"), threshold=0.8).collect()}
    first = {}
    for i, t in enumerate(text):
        first.setdefault(t, i)
    keys = sorted(first.values())
    want = {(i, j) for i in keys for j in keys if i < j and np.mean(prints[i] == prints[j]) >= 0.8}
    assert got == want and got


@pytest.mark.parametrize(("vectors", "avg", "share", "needs"), [([(3, 4), (0, 0), (1, 0)], 2.0, 1 / 3, False), ([(3, 0)] * 3 + [(0, 0)] * 2, 1.8, 0.6, True)])
def test_shake(spark, vectors, avg, share, needs):
    r = motion.shake(spark.createDataFrame([("v", x, y) for x, y in vectors], "video string, dx int, dy int")).first()
    assert (round(r.avg_motion, 9), round(r.significant, 9), r.needs_stabilization) == (avg, round(share, 9), needs)


def test_outliers_and_cleaning(spark):
    v = spark.createDataFrame([("v", 1, 1, 0), ("v", 2, 1, 0), ("v", 3, 2, 0), ("v", 4, 10, 0)], "video string, frame int, dx int, dy int")
    r = motion.outlier_frames(v).collect()
    assert [(x.frame, x.limit) for x in r] == [(4, 4.5)]
    assert sorted((x.frame, x.dx, x.was_outlier) for x in motion.cleaned(v).collect()) == [(1, 1, False), (2, 1, False), (3, 2, False), (4, 0, True)]


@pytest.mark.parametrize(("move", "want"), [(49, 0.0), (50, -3.4722222), (100, -6.9444444), (400, -20.0)])
def test_zoom(spark, move, want):
    assert round(one(spark, S.zoom_percent(F.lit(float(move)), F.lit(1920.0), F.lit(1080.0))), 7) == want


@pytest.mark.parametrize(("w", "h", "box", "want"), [(1280, 720, (3840, 2160), (3840, 2160)), (720, 1280, (3840, 2160), (2160, 3840)), (1000, 1000, (3840, 2160), (2160, 2160)), (1920, 800, (3840, 2160), (3840, 1600)), (853, 480, (3840, 2160), (3838, 2160)), (322, 240, (1920, 1080), (1450, 1080))])
def test_target_size(spark, w, h, box, want):
    assert tuple(one(spark, S.target_size(F.lit(w), F.lit(h), F.lit(box[0]), F.lit(box[1])))) == want


def test_passes_and_scales(spark):
    assert [one(spark, S.upscale_passes(F.lit(float(x)))) for x in (1, 3, 4, 9, 16, 17)] == [1, 1, 1, 2, 2, 3]
    assert [one(spark, S.last_pass_scale(F.lit(x))) for x in (1.0, 1.2, 2.25, 3.0, 2**1.5, 2**2.5)] == [2, 1, 2, 4, 4, 4]


@pytest.mark.parametrize(("text", "want"), [("30000/1001", 29.97002997002997), ("0/0", 0.0), ("25", 25.0), ("abc", 0.0), ("1/2/3", 0.5)])
def test_frame_rate(spark, text, want):
    assert one(spark, S.frame_rate(F.lit(text))) == want


@pytest.mark.parametrize("x", [0.05, 0.15, 0.25, 0.35, 49.65, 2.45, -0.05, -7.25, 1e6 + 0.25, 99.95, 0.0, 12.0, 49.64999999999999])
def test_one_decimal_is_pythons(spark, x):
    assert one(spark, S.one_decimal(F.lit(x))) == f"{x:.1f}"


def test_loss_texts(spark):
    r = one(spark, S.loss_verdict(F.lit(1000000), F.lit(800000), F.lit("target"), F.lit(95.0), 10.0))
    assert tuple(r) == (True, "Quality loss 5.0% within limit, size reduced 20.0%")
    assert one(spark, S.loss_verdict(F.lit(1000000), F.lit(800000), F.lit("none"), F.lit(95.0)))["reason"] == "Size reduced by 20.0% (no quality check)"
    assert tuple(one(spark, S.loss_verdict(F.lit(0), F.lit(5), F.lit("none"), F.lit(95.0)))) == (False, "Original size is zero")


def test_accelerations_and_encoders(spark):
    have = F.array(F.lit("vaapi"), F.lit("cuda"))
    assert [one(spark, S.resolve_acceleration(F.lit(x), have)) for x in ("auto", "qsv", "none", "VAAPI")] == ["cuda", "none", "none", "vaapi"]
    assert [one(spark, S.encoder(F.lit(c), F.lit("cuda"))) for c in ("libx264", "libvpx-vp9", "copy")] == ["h264_nvenc", "libvpx-vp9", "copy"]
    assert one(spark, files.accelerations(F.lit("Hardware acceleration methods:\n CUDA \n\nvaapi\n"))) == ["cuda", "vaapi"]


@pytest.mark.parametrize(("req", "want"), [(["encode", "upscale", "stabilize", "denoise_video"], ["stabilize", "denoise_video", "upscale", "encode"]), (["remux", "encode", "foo", "remux"], ["encode", "remux", "foo"])])
def test_order(spark, req, want):
    assert one(spark, planner.ordered(F.array(*map(F.lit, req)))) == want


def test_schedule(spark):
    jobs = spark.createDataFrame([("A", 0, 0), ("B", 5, 1), ("C", 0, 2), ("D", 5, 3)], "job string, priority int, seq long")
    assert [r.job for r in planner.schedule(jobs).orderBy("position").collect()] == ["B", "D", "A", "C"]


def results(spark, rows):
    return spark.createDataFrame(rows, "job_id string, ord int, stage string, status string, duration_sec double, output_path string, error string, input_path string")


def test_rollup(spark):
    rows = [("j", 1, "detect", "completed", 1.0, None, None, "I"), ("j", 2, "stabilize", "failed", 1.0, None, "boom", "I"), ("j", 3, "denoise_video", "completed", 1.0, "A", None, "I"), ("j", 4, "encode", "completed", 1.0, "F", None, "I")]
    r = runner.rollup(results(spark, rows)).first()
    assert (r.success, r.n_errors, r.errors, r.output_path) == (False, 1, "stabilize: boom", "F")
    assert [x.stage_input for x in runner.input_chain(results(spark, rows)).orderBy("ord").collect()] == ["I", "I", "I", "A"]
    r = runner.rollup(results(spark, rows), stop_on_error=True).first()
    assert (r.n_stages, r.success, r.output_path) == (2, False, None)
    r = runner.rollup(results(spark, [rows[0], (*rows[3][:3], "skipped", 0.0, None, None, "I")])).first()
    assert (r.success, r.output_path, r.skipped) == (True, None, "encode")


@pytest.mark.parametrize(("n", "factor", "want"), [(3, 2, 5), (1, 2, 1), (3, 4, 9), (3, 1, 3)])
def test_interpolation_count(spark, n, factor, want):
    x = spark.createDataFrame([("v", i, float(i)) for i in range(n)], "video string, idx long, value double")
    got = sorted((r.pos, round(r.value, 9)) for r in sequence.interpolate(x, "video", "idx", "value", factor).collect())
    assert got == [(i, round(i / max(1, factor), 9)) for i in range(want)]


@pytest.mark.parametrize(("total", "want"), [(29, 29), (59, 59), (60, 30), (89, 45)])
def test_even_sampling(spark, total, want):
    x = spark.range(total).select(F.lit("v").alias("video"), F.col("id").alias("idx"))
    assert sequence.sample_even(x, "video", "idx").count() == want


def test_probe_takes_garbage(spark):
    rows = [(1, '{"streams":[{"codec_type":"video","avg_frame_rate":"","r_frame_rate":"24/1","bit_rate":"x","disposition":{"default":1},"tags":{"language":"de"}}],"format":{"duration":"1.5"}}'), (2, "not json"), (3, None)]
    x = {r.id: r for r in probe.media_info(probe.parse_probe(spark.createDataFrame(rows, "id int, probe string"))).collect()}
    assert (x[1].framerate, x[1].duration, x[1].has_video, x[1].has_audio) == (24.0, 1.5, True, False)
    assert (x[2].n_streams, x[2].duration, x[2].has_video) == (0, 0.0, False) and x[3].format_name == ""


def test_logs(spark):
    x = logs.summary_metrics(F.lit("frame= 18 psnr_y: 45.234\nPSNR average: 44.563"), "PSNR")
    assert one(spark, x["psnr"]) == 44.563
    assert one(spark, logs.summary_metrics(F.lit("SSIM average: 0.9750"), "SSIM")["ssim"]) == 0.975
    assert one(spark, logs.vmaf(F.lit("[]"))["vmaf"]) is None
    lines = spark.createDataFrame([("v", 1, "Frame 1 (List 2 [(LM 3 -4 1 1 1 0.1 0.2),(LM 1.5 2 1)])")], "video string, frame int, line string")
    assert [(r.dx, r.dy) for r in logs.motion_vectors(lines).collect()] == [(3, -4)]


def test_config(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("general:\n  max_concurrent_jobs: 10\n  new_key: new_value\n")
    tree = config.load_yaml(str(tmp_path / "c.yaml"))
    assert config.flatten(tree) == [("general.max_concurrent_jobs", "10"), ("general.new_key", "new_value")]
    merged = {r.path: r.value for r in config.merge(config.config_table(spark, list(T.DEFAULT_CONFIG)), config.config_table(spark, config.flatten(tree))).collect()}
    assert merged["general.max_concurrent_jobs"] == "10" and merged["general.log_level"] == "INFO"
    shallow = {r.path for r in config.replace_sections(config.config_table(spark, list(T.DEFAULT_CONFIG)), config.config_table(spark, config.flatten(tree))).collect()}
    assert "general.log_level" not in shallow and "ffmpeg.threads" in shallow
    assert config.load_yaml(str(tmp_path / "none.yaml")) == {}
    assert config.nested_get({"a": {"b": None}}, "a", "b", default=1) is None and config.nested_get({"a": 3}, "a", "b", default=1) == 1
    config.save_presets(config.presets(spark), str(tmp_path / "presets"))
    back = {r["name"]: r for r in config.load_presets(spark, str(tmp_path / "presets")).collect()}
    assert (back["4k60"].target_w, back["4k60"].fps, back["size_reduction"].crf, back["remux_only"].video_codec) == (3840, 60.0, 28, "copy") and len(back) == 7


def test_scans_of_real_folders(spark, tmp_path):
    for n in ("video1.mp4", "video2.mkv", "video3.avi", "readme.txt", "image.jpg", "sub/deep.mp4"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("x")
    videos = lambda r: files.classify(files.list_files(spark, str(tmp_path), r)).where("is_video").count()
    assert (videos(True), videos(False)) == (4, 3)


def test_pixels(spark):
    image = np.array([[[1, 2, 3]]], dtype=np.uint8)
    assert pixels.swap_channels(image).tolist() == [[[3, 2, 1]]]
    assert pixels.from_tensor(pixels.to_tensor(image)).tolist() == image.tolist()
    ramp = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    for method in ("nearest", "bilinear", "lanczos"):
        assert pixels.resize(ramp, 4, 4, method).tolist() == ramp.tolist()
        assert pixels.resize(ramp, 8, 6, method).shape == (8, 6, 3)
    assert np.allclose(pixels.augmented_mean(lambda x: x, ramp[..., 0].astype(float)), ramp[..., 0])
    rows = spark.createDataFrame([("v", 0, 4, 4, 3, bytearray(ramp.tobytes()))], "video string, frame_idx long, h int, w int, c int, data binary")
    r = pixels.map_frames(rows, lambda i: pixels.resize(i, 2, 2, "nearest")).first()
    assert (r.h, r.w, len(r.data)) == (2, 2, 12)


def test_plugins(spark):
    plugins.register_stage("test_double", lambda: F.col("x") > 1)(lambda df: df.withColumn("x", F.col("x") * 2))
    out, skipped = plugins.run_chain(spark.createDataFrame([(1,), (2,), (None,)], "x int"), ["test_double", "nowhere"])
    assert sorted((r.x for r in out.collect()), key=repr) == [1, 4, None] and skipped == ["nowhere"]
    assert plugins.tag_frames(spark.createDataFrame([("v",)], "video string"), "unknown").count() == 0


def test_streaming_scenes(spark, tmp_path):
    from framelake.streaming import watch

    luma = [0, 0, 0, 255, 255, 0, 0, 0, 0]
    spark.createDataFrame([("v", float(i), float(x)) for i, x in enumerate(luma)], "video string, t double, luma double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video string, t double, luma double").parquet(str(tmp_path / "in"))
    q = watch.stream_scenes(stream).writeStream.outputMode("append").format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert sorted((r.start_time, r.end_time) for r in spark.table("found").collect()) == [(0.0, 3.0), (3.0, 5.0)]
    finally:
        q.stop()


def test_sinks_and_cli(spark, tmp_path, capsys):
    from framelake import cli
    from framelake.sources import sinks

    frames = spark.createDataFrame([("a", i, float(i)) for i in range(6)] + [("b", 0, 1.0)], "video string, frame_idx long, luma double")
    sinks.write_frames(frames, str(tmp_path / "frames"), buckets=3)
    assert spark.read.parquet(str(tmp_path / "frames")).where("video = 'a'").count() == 6
    sinks.remux(frames, str(tmp_path / "orc"))
    assert spark.read.orc(str(tmp_path / "orc")).count() == 7
    sinks.write_reports(spark.createDataFrame([("x\ny",)], "report string"), str(tmp_path / "text"))
    (tmp_path / "in").mkdir()
    assert cli.main(["scan", str(tmp_path / "in")]) == 1
    (tmp_path / "in" / "a.mp4").write_text("x")
    (tmp_path / "p.json").write_text('{"streams":[{"codec_type":"video","width":640,"height":480}]}\n')
    assert cli.main(["scan", str(tmp_path / "in")]) == 0 and cli.main(["presets"]) == 0
    assert cli.main(["plan", str(tmp_path / "p.json"), "--preset", "4k60"]) == 0
    assert "upscale" in capsys.readouterr().out


def test_analysis_without_scenes(spark):
    from framelake.plans.analyze import analyse

    info = spark.createDataFrame([("v", 1.0)], "video string, duration double")
    none = spark.createDataFrame([], "video string, start_time double, end_time double, confidence double")
    r = analyse(info, none).first()
    assert (r.total_scenes, r.scenes) == (0, None)


def test_frames_of_equal_hashes_are_near_pairs(spark):
    from framelake.operators import fingerprint

    prints = spark.createDataFrame([(4, "1100"), (2, "1100"), (9, "1100"), (5, "1101"), (6, "0011"), (7, "")], "video long, bits string")
    assert {tuple(r) for r in fingerprint.near_pairs(prints, threshold=0.75).collect()} == {(2, 4, 1.0), (2, 9, 1.0), (2, 5, 0.75)}


def test_cuts_are_taken_below_the_reference_correlation(spark):
    from framelake import queries

    found = [r["corr"] for r in queries.correlation_cuts(spark, "/root/testdata/sf0.001").collect()]
    assert all(c < 0.98 for c in found) and any(c >= 0.2 for c in found)


def test_a_video_lists_up_to_twenty_scenes(spark):
    from framelake import queries

    assert 5 < max(r["place"] for r in queries.first_scenes(spark, "/root/testdata/sf0.001").collect()) <= 20


@pytest.mark.parametrize("threshold", [0.7, 0.95])
def test_probe_plans_miss_no_pair(threshold):
    rng = np.random.default_rng(7)
    n = 64
    plan = fingerprint.probe_plan(n, most := int(n * (1 - threshold) + 1e-9))
    assert sum(w for _, w, _ in plan) <= n and all(len(fingerprint.masks(w, r)) <= 4096 for _, w, r in plan)
    for _ in range(3000):  # any choice of most places
        differs = np.zeros(n, dtype=int)
        differs[rng.choice(n, most, replace=False)] = 1
        assert any(differs[b : b + w].sum() <= r for b, w, r in plan)


@pytest.mark.parametrize("threshold", [0.7, 0.95])
def test_near_pairs_equal_all_pairs(spark, threshold):
    from framelake import queries

    prints = queries._prints(spark, "/root/testdata/sf0.001").collect()
    rng = np.random.default_rng(1)
    text = [r.bits for r in prints] + ["".join(str(int(c) ^ int(rng.random() < 0.03)) for c in r.bits) for r in prints[:60]] + ["1", "0", "01"]
    words = [(len(t), int(t, 2)) for t in text]
    first = {}
    for i, w in enumerate(words):
        first.setdefault(w, i)
    keys = sorted(first.values())
    near = lambda i, j: words[i][0] == words[j][0] and words[i][0] - (words[i][1] ^ words[j][1]).bit_count() >= threshold * words[i][0]
    want = {(i, j) for i in keys for j in keys if i < j and near(i, j)} | {(first[w], i) for i, w in enumerate(words) if first[w] != i}
    got = [(r.a, r.b) for r in fingerprint.near_pairs(spark.createDataFrame(list(enumerate(text)), "video long, bits string"), threshold=threshold).collect()]
    assert set(got) == want and len(got) == len(want)


def test_exact_median_equals_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.normal(0, 3, 501)] + [("b", float(x)) for x in rng.integers(0, 4, 400)] + [("c", 2.5), ("d", None)]
    got = {r.g: r["median"] for r in motion.exact_median(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    assert got == {g: np.median([x for k, x in rows if k == g]) for g in "abc"}


def test_numbering_does_not_depend_on_blocks(spark):
    rows = spark.createDataFrame([("v", i * 7 % 50) for i in range(50)] + [("w", 3), (None, 1)], "g string, x int")
    for width in (1, 8, 100):
        got = sequence.numbered(rows, "g", ["x"], F.floor(F.col("x") / width)).collect()
        assert all(r.idx == (r.x + 1 if r.g == "v" else 1) for r in got) and len(got) == 52


def test_chains_grow_by_one_scan_a_stage_at_most(spark, tmp_path):
    spark.range(100).selectExpr("id % 10 AS x", "id AS y").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    for i in range(8):
        plugins.register_columns(f"step{i}", lambda i=i: F.col("x") > i)(lambda i=i: {"y": F.col("y") + i, f"z{i}": F.col("x")})
    out, skipped = plugins.run_chain(rows, [f"step{i}" for i in range(8)])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not skipped and plan.count("Relation") == 1
    assert sorted(r.y for r in out.collect()) == sorted(y + sum(i for i in range(8) if y % 10 > i) for y in range(100))
    for i in range(5):
        plugins.register_stage(f"whole{i}", lambda i=i: F.col("x") > i)(lambda df, i=i: df.withColumn("y", F.col("y") + i))
    out, _ = plugins.run_chain(rows, [f"whole{i}" for i in range(5)])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
    assert sorted(r.y for r in out.collect()) == sorted(y + sum(i for i in range(5) if y % 10 > i) for y in range(100))


def test_a_job_of_many_stages_lists_the_first_and_counts_all(spark):
    rows = [("j", i, f"s{i}", "failed", 1.0, None, "e", "I") for i in range(30)]
    r = runner.rollup(results(spark, rows), listed=3).first()
    assert (r.n_errors, r.errors) == (30, "s0: e; s1: e; s2: e")
    text = runner.report(results(spark, rows), listed=2).first().report
    assert "s1: 1.0s" in text and "s2: 1.0s" not in text


def test_schedule_with_narrow_ranges(spark):
    jobs = spark.createDataFrame([(i, i * 37 % 5, i * i) for i in range(200)], "job long, priority int, seq long")
    want = [i for i, _, _ in sorted(((i, -(i * 37 % 5), i * i) for i in range(200)), key=lambda r: r[1:])]
    for rows in (7, 1000):
        assert [r.job for r in planner.schedule(jobs, rows=rows).orderBy("position").collect()] == want
    assert planner.schedule(jobs.limit(0)).count() == 0


def test_command_line_analyses_and_finds_duplicates(spark, tmp_path, capsys):
    from framelake import cli

    luma = [0, 0, 0, 255, 255, 0, 0, 0, 0]
    spark.createDataFrame([("v", float(i), float(x)) for i, x in enumerate(luma)], "video string, t double, luma double").write.parquet(str(tmp_path / "frames"))
    assert cli.main(["analyze", str(tmp_path / "frames")]) == 0 and "5.0\t8.0\t0.5" in capsys.readouterr().out
    shots = [("a", [10, 20, 30, 40]), ("b", [11, 20, 30, 41]), ("c", [40, 30, 20, 10])]
    spark.createDataFrame(shots, "video string, pixels array<int>").write.parquet(str(tmp_path / "shots"))
    assert cli.main(["find-duplicates", str(tmp_path / "shots"), "a"]) == 0
    out = capsys.readouterr().out
    assert "b\t1.0" in out and "c\t" not in out
    assert cli.main(["find-duplicates", str(tmp_path / "shots"), "z"]) == 1 and cli.main(["analyze", str(tmp_path / "none")]) == 1
    (tmp_path / "p.json").write_text('{"streams":[{"codec_type":"video","width":640,"height":480}]}\n')
    assert cli.main(["process", str(tmp_path / "p.json"), "--preset", "4k60", "--dry-run"]) == 0 and "upscale" in capsys.readouterr().out
    plugins.register_columns("upscale", lambda: F.lit(True))(lambda: {"luma": F.col("luma") * 2})
    try:
        assert cli.main(["process", str(tmp_path / "p.json"), "--preset", "4k60", "--frames", str(tmp_path / "frames"), "--output", str(tmp_path / "out")]) == 0
        assert spark.read.parquet(str(tmp_path / "out")).agg(F.max("luma")).first()[0] == 510.0
    finally:
        del plugins.REGISTRY["upscale"]


def test_layers_of_configuration(spark):
    table = lambda rows: config.config_table(spark, rows)
    got = config.layered([("d", table([("a.b", "1"), ("a.c", "2"), ("x", "3"), ("y.z", None)])), ("u", table([("a", "off"), ("x.y", "4")])), ("p", table([("a.b", "5")]))])
    assert {r.path: (r.value, r.origin) for r in got.collect()} == {"a.b": ("5", "p"), "x.y": ("4", "u"), "y.z": (None, "d")}


def test_a_model_is_loaded_once_and_passes_are_chained(spark):
    assert [pixels.pass_scales(x) for x in (1, 2, 4, 8, 16)] == [[], [2], [4], [4, 2], [4, 4]]
    calls = []
    load = lambda: calls.append(1) or (lambda images, scale: images)
    assert pixels.loaded("once", load) is pixels.loaded("once", load) and calls == [1]


def test_queue_with_errors_and_a_cancellation(spark):
    jobs = planner.schedule(spark.createDataFrame([("A", 0, 0), ("B", 5, 1), ("C", 0, 2)], "job_id string, priority int, seq long"))
    rows = [("A", 1, "detect", "failed", 1.0, None, "boom", "I"), ("B", 1, "detect", "completed", 1.0, "O", None, "I")]
    raised = spark.createDataFrame([("C", "no file")], "job_id string, error string")
    got = {r.job_id: (r.position, r.success, r.errors, r.told) for r in runner.execute_all(jobs, results(spark, rows), raised).collect()}
    assert got == {"B": (1, True, "", True), "A": (2, False, "detect: boom", True), "C": (3, False, "no file", False)}
    assert {r.job_id for r in runner.execute_all(jobs, results(spark, rows), raised, cancelled_from=2).collect()} == {"B"}


def test_stabilising_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([("v", i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(-3, 4, (40, 2)))], "video string, frame int, dx int, dy int")
    for width in (7, 1000):
        got = [round(r.x) for r in motion.camera_path(v, block_frames=width).orderBy("frame").collect()]
        assert got == np.cumsum([r.dx for r in v.orderBy("frame").collect()]).tolist()


def test_extracted_frames_start_within_the_video(spark):
    frames = spark.createDataFrame([("v", i) for i in range(5)] + [("w", 0), (None, 0), (None, 1)], "video string, idx int")
    at = lambda **kw: sorted((str(r.video), r.idx) for r in sequence.extract(frames, "video", "idx", 1.0, **kw).collect())
    assert at(start=3.0) == [("None", 1), ("v", 3), ("v", 4), ("w", 0)]
    assert at(start=99.0) == [("None", 1), ("v", 4), ("w", 0)]
    assert at(start=-2.0, end=0.0, most=1) == [("None", 0), ("v", 0), ("w", 0)]
    assert at(start=1.0, end=3.0, most=0) == [("None", 1), ("v", 1), ("v", 2), ("w", 0)]
    assert at(start=1.0, end=1.0) == [] and at(start=0.0, most=0) == []


def test_times_of_frames_by_place(spark):
    frames = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)], "video string, idx int")
    times = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.9), ("a", 1, 0.8), ("c", 0, 7.0)], "video string, idx int, t double")
    got = {(r.video, r.idx): r.t for r in sequence.with_times(frames, times, "video", "idx").collect()}
    assert got == {("a", 0): 0.5, ("a", 1): 0.8, ("a", 2): 0.0, ("b", 0): 0.0, ("b", 1): 1.0}


def test_devices_and_number_formats(spark):
    rows = [("auto", ["mps", "cuda"]), ("auto", ["mps"]), ("auto", []), ("auto", None), ("cuda", ["mps"]), ("mps", ["mps"]), ("tpu", ["tpu"]), (None, ["cuda"])]
    x = spark.createDataFrame(rows, "wish string, have array<string>").select(S.device(F.col("wish"), F.col("have")).alias("d"))
    assert [r.d for r in x.collect()] == ["cuda", "mps", "cpu", "cpu", "cpu", "mps", "cpu", "cpu"]
    y = spark.createDataFrame([("fp16",), ("bf16",), ("int8",), (None,)], "k string").select(S.dtype(F.col("k")).alias("d"))
    assert [r.d for r in y.collect()] == ["float16", "bfloat16", "float32", "float32"]


def test_a_job_is_queued_while_idle(spark):
    x = spark.createDataFrame([("idle",), ("running",), (None,)], "s string").select(runner.is_queued(F.col("s")).alias("q"))
    assert [r.q for r in x.collect()] == [True, False, False]
