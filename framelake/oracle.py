"""DuckDB SQL with the same results as ``queries``, written from the rules and not from the Spark plans."""

from __future__ import annotations

from .functions import tables as T
from .views import AUDIO_CODECS, EXTENSIONS, FORMATS, MODEL_FOLDERS, TRANSFERS, VIDEO_CODECS

_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_pick = lambda xs, i: f"{_list(xs)}[CAST(({i}) % {len(xs)} + 1 AS INTEGER)]"
_map = lambda m: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"
ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"

FILES = f"""files AS (SELECT p_partkey AS file_id, '/lib/' || p_brand || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || {_pick(EXTENSIONS, 'p_partkey')} AS path FROM part),
parts AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)) AS ext FROM files)"""
RATE = "CASE WHEN l_suppkey % 5 = 0 THEN 0.0::DOUBLE ELSE (l_partkey % 90)::DOUBLE / (l_suppkey % 5)::DOUBLE END"
STREAMS = f"""s0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS INTEGER) AS idx,
  CASE l_returnflag WHEN 'N' THEN 'video' WHEN 'A' THEN 'audio' ELSE 'subtitle' END AS codec_type FROM lineitem),
streams AS (SELECT l_orderkey AS media_id, idx, codec_type, CASE codec_type WHEN 'video' THEN {_pick(VIDEO_CODECS, 'l_suppkey')} WHEN 'audio' THEN {_pick(AUDIO_CODECS, 'l_suppkey')} ELSE 'srt' END AS codec_name,
  CAST(trunc(l_quantity * 80) AS INTEGER) AS width, CAST(trunc(l_quantity * 45) AS INTEGER) AS height, {RATE} AS fps, {_pick(TRANSFERS, 'l_partkey')} AS color_transfer, l_partkey * 10 AS bit_rate FROM s0)"""
MEDIA = f"""{STREAMS},
firsts AS (SELECT media_id, min(idx) FILTER (codec_type = 'video') AS v, count(*) FILTER (codec_type = 'audio') AS n_audio, count(*) AS n_streams,
  coalesce(string_agg(codec_name, ',' ORDER BY idx) FILTER (codec_type = 'audio'), '') AS audio_codecs FROM streams GROUP BY 1),
info AS (SELECT o_orderkey AS media_id, o_totalprice / 1000 AS duration, {_pick(FORMATS, 'o_custkey')} AS format_name, coalesce(s.width, 0) AS width, coalesce(s.height, 0) AS height, coalesce(s.fps, 0.0::DOUBLE) AS framerate,
  f.v IS NOT NULL AS has_video, n_audio > 0 AS has_audio, coalesce(lower(s.color_transfer) IN {_in(T.HDR_TRANSFERS)}, false) AS is_hdr, coalesce(s.codec_name, '') AS video_codec, audio_codecs, CAST(n_audio AS INTEGER) AS n_audio, CAST(n_streams AS INTEGER) AS n_streams
  FROM orders JOIN firsts f ON f.media_id = o_orderkey LEFT JOIN streams s ON s.media_id = f.media_id AND s.idx = f.v)"""
FRAMES = """f0 AS (SELECT user_id AS video, event_id, epoch_us(ts) AS us, value AS luma FROM events),
frames AS (SELECT *, (us - min(us) OVER (PARTITION BY video))::DOUBLE / 1e6 AS t, row_number() OVER (PARTITION BY video ORDER BY us, event_id) - 1 AS idx FROM f0)"""
SCORED = FRAMES + """, scored AS (SELECT *, coalesce(abs(luma - lag(luma) OVER (PARTITION BY video ORDER BY us, event_id)) / 255.0::DOUBLE, 0.0::DOUBLE) AS score FROM frames)"""
VECTORS = "vectors AS (SELECT l_orderkey AS video, l_partkey AS frame, CAST(trunc(l_quantity) AS INTEGER) % 7 - 3 AS dx, CAST(round(l_discount * 100) AS INTEGER) % 5 - 2 AS dy FROM lineitem), mags AS (SELECT *, sqrt((dx * dx + dy * dy)::DOUBLE) AS m FROM vectors)"
SHOTS = "shots AS (SELECT label AS video, vec_id AS frame, list_transform(embedding, lambda x: x::DOUBLE) AS px FROM embeddings)"
PRINTS = SHOTS + ", px AS (SELECT frame, generate_subscripts(px, 1) AS i, unnest(px) AS x, list_avg(px) AS m FROM shots), bitrows AS (SELECT frame, i, CASE WHEN x > m THEN '1' ELSE '0' END AS b FROM px), prints AS (SELECT frame AS video, string_agg(b, '' ORDER BY i) AS bits FROM bitrows GROUP BY 1)"
RESULTS = f"""r0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS INTEGER) AS ord FROM lineitem),
results AS (SELECT l_orderkey AS job_id, ord, {_pick(T.STAGE_ORDER, 'ord - 1')} AS stage, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE 'skipped' END AS status, l_quantity AS duration_sec,
  CASE WHEN l_returnflag = 'A' THEN '/out/' || l_orderkey || '/' || ord END AS output_path, 'E' || l_suppkey AS error, '/in/' || l_orderkey AS input_path FROM r0)"""
ROLLUP = f"""{RESULTS}, rolled AS (SELECT job_id, count(*) AS n_stages, count(*) FILTER (status = 'failed') AS n_errors, count(*) FILTER (status = 'skipped') AS n_skipped, sum(duration_sec) AS total_duration,
  coalesce(string_agg(stage || ': ' || error, '; ' ORDER BY ord) FILTER (status = 'failed'), '') AS errors, coalesce(string_agg(stage, '; ' ORDER BY ord) FILTER (status = 'skipped'), '') AS skipped, arg_max_null(output_path, ord) AS output_path FROM results GROUP BY 1)"""
MODE = "['none', 'target', 'min', 'avg', 'max'][CAST(l_suppkey % 5 + 1 AS INTEGER)]"
QUALITY = """CASE mode WHEN 'min' THEN l_quantity WHEN 'avg' THEN l_quantity * 2 + 0.5 WHEN 'max' THEN CASE WHEN l_partkey % 2 = 0 THEN l_quantity * 2 + 1 ELSE l_quantity * 2 END ELSE l_quantity * 2 END"""
FIXED_ON = "['stabilize', 'denoise_video', 'deblock', 'normalize_volume', 'normalize_audio']"
PLANNED = f"""{MEDIA}, planned AS (SELECT *, list_concat(['detect'], list_filter([CASE WHEN width < 1920 OR height < 1080 THEN 'upscale' END, CASE WHEN framerate > 0 AND framerate < 60 THEN 'interpolate' END, CASE WHEN is_hdr THEN 'hdr' END], lambda x: x IS NOT NULL), {FIXED_ON}, ['encode']) AS stages FROM info)"""
MODEL_FILES = f"""listed AS (SELECT CASE WHEN p_partkey % 8 < 4 THEN {_pick([m[1] for m in T.MODELS[:4]], 'p_partkey % 4')} ELSE 'own_' || p_partkey || '.pth' END AS filename,
  {_pick(MODEL_FOLDERS, 'p_partkey // 8')} AS dir, p_size::BIGINT * 1000000 AS size_bytes FROM part)"""
HABLE = "((({x}) * (({x}) * 0.15 + 0.05) + 0.004) / (({x}) * (({x}) * 0.15 + 0.5) + 0.06) - 0.02 / 0.3)"


def _hable(x: str) -> str:
    return HABLE.replace("{x}", x).replace("0.15", "0.15::DOUBLE")


def _size() -> str:
    return """SELECT media_id, idx, CAST(tw + tw % 2 AS INTEGER) AS target_w, CAST(th + th % 2 AS INTEGER) AS target_h FROM (
      SELECT media_id, idx, CAST(trunc(w * least(bw::DOUBLE / w, bh::DOUBLE / h)) AS INTEGER) AS tw, CAST(trunc(h * least(bw::DOUBLE / w, bh::DOUBLE / h)) AS INTEGER) AS th FROM (
        SELECT *, CASE WHEN h > w THEN 2160 WHEN w > h THEN 3840 ELSE 2160 END AS bw, CASE WHEN h > w THEN 3840 WHEN w > h THEN 2160 ELSE 2160 END AS bh FROM (
          SELECT media_id, idx, CASE WHEN idx % 3 = 0 THEN height ELSE width END AS w, CASE WHEN idx % 3 = 2 THEN height ELSE width END AS h FROM streams WHERE codec_type = 'video')))"""


def _fourcc(c: str) -> str:
    return f"coalesce({_map(T.FOURCC)}[{c}], 'H264')"


def _encoder() -> str:
    cases = " ".join(f"WHEN codec = '{c}' AND acceleration = '{a}' THEN '{h}'" for c, own in T.HARDWARE_CODECS.items() for a, h in own.items())
    return f"CASE {cases} ELSE codec END"


def _first_acceleration() -> str:
    return "CASE " + " ".join(f"WHEN list_contains(have, '{a}') THEN '{a}'" for a in T.ACCELERATIONS) + " ELSE 'none' END"


def _presets() -> str:
    rows = []
    for name, w, h, fps, vc, ac, crf, speed, on, off in T.PRESETS:
        if w:
            rows += [(name, "quality.quality_target.mode", "target"), (name, "quality.quality_target.target", crf), (name, "quality.quality_target.target_resolution", f"[{w}, {h}]"), (name, "quality.quality_target.target_framerate", fps)]
        rows += [(name, f"stages.{x}.enabled", "true") for x in on] + [(name, f"stages.{x}.enabled", "false") for x in off]
        rows += [(name, "encoding.video_codec", vc), (name, "encoding.audio_codec", ac), (name, "encoding.crf", crf), (name, "encoding.preset", speed)]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows) + ") t(preset, path, value)"


def _config() -> str:
    base = ", ".join(f"('{k}', '{v}')" for k, v in T.DEFAULT_CONFIG)
    return f"""WITH b AS (SELECT * FROM (VALUES {base}) t(path, value)), o AS (SELECT * FROM (VALUES ('general.max_concurrent_jobs', '10'), ('general.new_key', 'new_value'), ('quality.quality_target.target', NULL)) t(path, value))
    SELECT coalesce(o.path, b.path) AS path, CASE WHEN o.path IS NOT NULL THEN o.value ELSE b.value END AS value, CASE WHEN o.path IS NOT NULL THEN 'override' ELSE 'default' END AS origin FROM b FULL OUTER JOIN o ON b.path = o.path"""


def _layers() -> str:
    """The three layers with what a later one hides: a leaf hides what lies under it, a subtree the leaf above it."""
    values = lambda rows: ", ".join(f"('{k}', '{v}')" for k, v in rows)
    return f"""WITH layers AS (SELECT path, value, 0 AS layer, 'default' AS origin FROM (VALUES {values(T.DEFAULT_CONFIG)}) t(path, value)
      UNION ALL SELECT path, value, 1, 'user' FROM (VALUES ('general.log_level', 'DEBUG'), ('quality.quality_target', 'off'), ('encoding.crf', '30'), ('stages.speed.enabled.forced', 'yes')) t(path, value)
      UNION ALL SELECT path, value, 2, 'preset' FROM ({_presets()}) WHERE preset = '4k60')
    SELECT path, value, origin FROM layers a WHERE NOT EXISTS (SELECT 1 FROM layers b WHERE b.layer > a.layer AND (b.path = a.path OR starts_with(a.path, b.path || '.') OR starts_with(b.path, a.path || '.')))"""


def _models() -> str:
    reg = ", ".join(f"('{n}', '{f}', '{d}')" for n, f, _, d, _ in T.MODELS)
    mb = "round(size_bytes::DOUBLE / (1024.0::DOUBLE * 1024.0), 1)"
    return f"""WITH {MODEL_FILES}, reg AS (SELECT * FROM (VALUES {reg}) t(name, filename, description)), cached AS (SELECT filename, max(size_bytes) AS size_bytes FROM listed GROUP BY 1)
    SELECT name, reg.filename AS filename, description, size_bytes IS NOT NULL AS cached, {mb} AS actual_mb FROM reg LEFT JOIN cached ON reg.filename = cached.filename
    UNION ALL SELECT filename, filename, 'Custom model', true, {mb} FROM cached WHERE filename NOT IN (SELECT filename FROM reg)"""


def _matrix() -> str:
    canon = _list(T.STAGE_ORDER)
    return f"""WITH {PLANNED}, rows AS (SELECT media_id, width, height, has_audio, is_hdr, video_codec, unnest(list_filter({canon}, lambda x: list_contains(stages, x))) AS stage, generate_subscripts(list_filter({canon}, lambda x: list_contains(stages, x)), 1) - 1 AS ord FROM planned),
    judged AS (SELECT *, CASE WHEN stage = 'deblock' AND video_codec IN {_in(T.CLEAN_CODECS)} THEN 'Lossless codec - no deblocking needed' WHEN stage = 'denoise_video' AND (width = 0 OR height = 0) THEN 'No video stream'
      WHEN stage = 'upscale' AND width >= 1920 AND height >= 1080 THEN 'Already at target resolution' WHEN stage = 'interpolate' THEN 'No target framerate specified' WHEN stage IN ('normalize_audio', 'normalize_volume') AND NOT has_audio THEN 'No audio stream'
      WHEN stage = 'hdr' AND NOT is_hdr THEN 'Content is not HDR' ELSE '' END AS reason FROM rows)
    SELECT media_id, CAST(ord AS INTEGER) AS ord, stage, reason = '' AS run, reason FROM judged"""


SCENES = SCORED + """, cuts AS (SELECT video, t, max(score) AS score FROM scored WHERE score > 0.3 GROUP BY ALL), s AS (SELECT video, coalesce(lag(t) OVER (PARTITION BY video ORDER BY t), 0.0::DOUBLE) AS start_time, t AS end_time, score AS confidence FROM cuts),
          e AS (SELECT video, coalesce(max(t) FILTER (score > 0.3), 0.0::DOUBLE) AS start_time, max(t) AS end_time, 0.5::DOUBLE AS confidence FROM scored GROUP BY 1),
          scenes AS (SELECT * FROM s WHERE end_time - start_time >= 7200 UNION ALL SELECT * FROM e WHERE start_time < end_time), placed AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start_time, end_time) AS place FROM scenes)"""


def oracle_sql() -> dict[str, str]:
    v, im = _in(T.VIDEO_EXTENSIONS), _in(T.IMAGE_EXTENSIONS)
    ext = "regexp_extract(path, '[^/]+(\\.[^./]+)$', 1)"
    return {
        "classify_files": f"WITH {FILES} SELECT path, ext, ext IN {v} AS is_video, ext IN {im} AS is_image FROM parts",
        "scan_directory_recursive": f"WITH {FILES} SELECT dir, name, path, row_number() OVER (PARTITION BY dir ORDER BY name, path) - 1 AS ord FROM parts WHERE (dir = '/lib' OR dir LIKE '/lib/%') AND ext IN {v}",
        "scan_directory_flat": f"WITH {FILES} SELECT dir, name, path, row_number() OVER (PARTITION BY dir ORDER BY name, path) - 1 AS ord FROM parts WHERE dir = '/lib/Brand#11' AND ext IN {v}",
        "add_files": f"WITH {FILES} SELECT path, dir || '/' || left(name, length(name) - length({ext})) || '_enhanced' || {ext} AS output_path FROM parts WHERE dir IN ('/lib/Brand#11', '/lib/Brand#12') AND ext IN {v}",
        "probe_parse_streams": f"WITH {STREAMS} SELECT media_id, idx AS stream_index, codec_type, codec_name, width, height, fps, bit_rate, color_transfer FROM streams WHERE media_id IN (SELECT o_orderkey FROM orders)",
        "media_info": f"WITH {MEDIA} SELECT * FROM info",
        "detect_needs": f"WITH {MEDIA} SELECT media_id, concat_ws(',', CASE WHEN is_hdr THEN 'hdr' END, CASE WHEN framerate > 0 AND framerate < 30 THEN 'interpolate' END, CASE WHEN format_name IN {_in(T.REMUX_FORMATS)} THEN 'remux' END) AS needs_processing, false AS shake_detected FROM info",
        "frame_rate_parse": f"WITH {STREAMS} SELECT media_id, idx, fps FROM streams",
        "frame_sampling_even": f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY video) AS c FROM frames) SELECT video, idx, event_id FROM n WHERE idx % greatest(1, c // 30) = 0",
        "frame_sampling_interval": f"WITH {FRAMES} SELECT video, idx, event_id FROM frames WHERE idx % 5 = 0 AND idx < 100",
        "frame_extract": f"WITH {FRAMES} SELECT video, idx, event_id FROM (SELECT *, least(10, max(idx) OVER (PARTITION BY video)) AS a FROM frames) WHERE idx >= a AND idx < a + least(100, 30)",
        "frame_pairs": f"WITH {FRAMES}, p AS (SELECT *, lag(event_id) OVER (PARTITION BY video ORDER BY idx) AS prev_event_id FROM frames) SELECT video, idx, event_id, prev_event_id FROM p WHERE idx >= 1 AND idx % 3 = 0",
        "frame_scores": f"WITH {SCORED} SELECT video, event_id, t, score FROM scored",
        "scene_segments": f"WITH {SCENES} SELECT * FROM scenes",
        "first_scenes": f"WITH {SCENES} SELECT video, start_time, end_time, confidence, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 20",
        "video_analysis": f"""WITH {SCENES}, n AS (SELECT video, count(*) AS n_frames, max(t) AS duration FROM frames GROUP BY 1), g AS (SELECT video, count(*) AS c, round(sum(end_time - start_time), 4) AS scene_seconds, min(end_time) FILTER (place = 1) AS first_end FROM placed GROUP BY 1)
          SELECT video, n_frames, duration, coalesce(c, 0) AS total_scenes, scene_seconds, CAST(least(c, 20) AS INTEGER) AS n_listed, first_end FROM n LEFT JOIN g USING (video)""",
        "sample_seconds": f"WITH {FRAMES} SELECT video, CAST(floor(t / 3600.0::DOUBLE) AS BIGINT) AS second, min(idx) AS idx FROM frames GROUP BY ALL",
        "stage_progress": f"WITH {RESULTS} SELECT job_id, ord, ord = max(ord) OVER (PARTITION BY job_id) AS is_last, round((ord - 1 + least(1.0::DOUBLE, duration_sec / 40.0::DOUBLE)) / count(*) OVER (PARTITION BY job_id), 8) AS overall FROM results",
        "job_sizes": "SELECT p_partkey AS job_id, round(coalesce(p_retailprice / nullif(p_size * 10 * (p_partkey % 4), 0), 0.0::DOUBLE), 8) AS size_ratio FROM part",
        "job_status": f"WITH {ROLLUP} SELECT CASE WHEN job_id % 10 = 0 THEN 'cancelled' WHEN n_errors = 0 THEN 'completed' ELSE 'failed' END AS status, count(*) AS n FROM rolled GROUP BY 1",
        "model_paths": f"""WITH {MODEL_FILES}, reg AS (SELECT * FROM (VALUES {', '.join(f"('{m[0]}', '{m[1]}')" for m in T.MODELS)}) t(name, filename))
          SELECT name, arg_min(dir || '/' || listed.filename, CASE WHEN dir = 'models' THEN '1' ELSE '0' END || dir || '/' || listed.filename) AS path FROM reg LEFT JOIN listed ON reg.filename = listed.filename GROUP BY 1""",
        "stage_parameters": f"""SELECT event_id, CASE event_id % 4 {' '.join(f"WHEN {i} THEN '{':'.join(map(str, T.DENOISE[k]))}'" for i, k in ((0, 'low'), (1, 'medium'), (2, 'high'), (3, 'medium')))} END AS denoise,
          {_pick(('low', 'medium', 'high', 'extreme'), 'event_id')} || '=1:ssim=1' AS flags, {_pick(('OK', 'SKIP', 'FAIL'), 'event_id')} AS icon FROM events""",
        "correlation_cuts": f"""WITH {SHOTS}, p AS (SELECT video, frame, px, lag(px) OVER (PARTITION BY video ORDER BY frame) AS q FROM shots), u AS (SELECT video, frame, unnest(px) AS x, unnest(q) AS y FROM p WHERE q IS NOT NULL)
          SELECT * FROM (SELECT video, frame, round(corr(x, y), 8) AS corr FROM u GROUP BY ALL) WHERE corr < {T.CORRELATION_CUT}""",
        "pixel_difference": f"""WITH {SHOTS}, p AS (SELECT video, frame, px, lag(px) OVER (PARTITION BY video ORDER BY frame) AS q FROM shots), u AS (SELECT video, frame, unnest(px) AS x, unnest(q) AS y FROM p WHERE q IS NOT NULL)
          SELECT video, frame, round(avg(abs(x - y)) / 255, 10) AS score FROM u GROUP BY ALL""",
        "video_fingerprint": f"""WITH {SHOTS}, px AS (SELECT video, frame, generate_subscripts(px, 1) AS i, unnest(px) AS x, list_avg(px) AS m FROM shots), c AS (SELECT video, i, count(*) FILTER (x > m) AS ones, count(*) AS n FROM px GROUP BY ALL)
          SELECT video, string_agg(CASE WHEN ones * 2 > n THEN '1' ELSE '0' END, '' ORDER BY i) AS bits, max(n) AS n_frames FROM c GROUP BY 1""",
        "find_similar": f"WITH {PRINTS} SELECT a.video, round(1 - hamming(a.bits, b.bits) / 64.0::DOUBLE, 8) AS similarity, row_number() OVER (ORDER BY hamming(a.bits, b.bits), a.video) AS rank FROM prints a, prints b WHERE b.video = 0 AND a.video <> 0 AND 64 - hamming(a.bits, b.bits) >= 0.55 * 64",
        "near_duplicate_pairs": f"""WITH {PRINTS}, e AS (SELECT bits, min(video) AS k FROM prints GROUP BY 1) SELECT a.k AS a, b.k AS b, round(1 - hamming(a.bits, b.bits) / 64.0::DOUBLE, 8) AS similarity FROM e a, e b WHERE a.k < b.k AND 64 - hamming(a.bits, b.bits) >= 0.70 * 64
          UNION ALL SELECT k, video, 1.0::DOUBLE FROM prints JOIN e USING (bits) WHERE video <> k""",
        "shake_analysis": f"WITH {VECTORS} SELECT video, round(avg(m), 8) AS avg_motion, round(max(m), 8) AS max_motion, round(avg(CASE WHEN m > 2 THEN 1.0::DOUBLE ELSE 0 END), 8) AS significant, avg(m) > 2 OR avg(CASE WHEN m > 2 THEN 1.0::DOUBLE ELSE 0 END) > 0.5 AS needs_stabilization FROM mags GROUP BY 1",
        "motion_outliers": f"WITH {VECTORS}, f AS (SELECT video, frame, avg(m) AS motion FROM mags GROUP BY ALL), l AS (SELECT video, median(motion) * 3 AS lim FROM f GROUP BY 1) SELECT video, frame, round(motion, 8) AS motion, round(lim, 8) AS motion_limit FROM f JOIN l USING (video) WHERE motion > lim",
        "motion_cleaned": f"""WITH {VECTORS}, f AS (SELECT video, frame, avg(m) AS motion FROM mags GROUP BY ALL), l AS (SELECT video, median(motion) * 3 AS lim FROM f GROUP BY 1), bad AS (SELECT video, frame FROM f JOIN l USING (video) WHERE motion > lim)
          SELECT v.video, count(bad.video) AS n_cleaned, CAST(sum(CASE WHEN bad.video IS NULL THEN dx ELSE 0 END) AS BIGINT) AS sum_dx, CAST(sum(CASE WHEN bad.video IS NULL THEN dy ELSE 0 END) AS BIGINT) AS sum_dy, count(*) AS n FROM vectors v LEFT JOIN bad ON v.video = bad.video AND v.frame = bad.frame GROUP BY 1""",
        "zoom_estimate": f"""WITH {VECTORS}, z AS (SELECT video, greatest((max(dx) - min(dx)) * 60, (max(dy) - min(dy)) * 60)::DOUBLE AS movement FROM vectors GROUP BY 1)
          SELECT video, movement, round(CASE WHEN movement < 50 THEN 0.0::DOUBLE ELSE greatest(-20.0::DOUBLE, least(0.0::DOUBLE, -(movement / 1080) * 100 * 0.75)) END, 8) AS zoom FROM z""",
        "trf_text_parse": f"WITH {VECTORS} SELECT video, count(*) AS n, CAST(sum(dx) AS BIGINT) AS sum_dx, CAST(sum(dy) AS BIGINT) AS sum_dy FROM vectors GROUP BY 1",
        "quality_pairs": f"""WITH {SHOTS}, u AS (SELECT CAST(a.frame // 2 AS BIGINT) AS pair, unnest(a.px) AS x, unnest(b.px) AS y FROM shots a JOIN shots b ON a.frame % 2 = 0 AND b.frame = a.frame + 1),
          m AS (SELECT pair, avg((x - y) * (x - y)) AS mse, avg(x) AS ma, avg(y) AS mb, avg(x * x) - avg(x) * avg(x) AS va, avg(y * y) - avg(y) * avg(y) AS vb, avg(x * y) - avg(x) * avg(y) AS cov FROM u GROUP BY 1)
          SELECT pair, round(mse, 6) AS mse, round(CASE WHEN mse = 0 THEN 100.0::DOUBLE ELSE 10 * log10(1 / mse) END, 6) AS psnr, round(((2 * ma * mb + 1e-4) * (2 * cov + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4)), 6) AS ssim FROM m""",
        "quality_log_parse": "WITH x AS (SELECT event_id, value AS a, (event_id % 50) + 0.5::DOUBLE AS b FROM events) SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN a ELSE (a + b) / 2 END, 6) AS psnr, round(least(a, b), 6) AS psnr_min, round(greatest(a, b), 6) AS psnr_max, 0.5::DOUBLE AS ssim_line FROM x",
        "vmaf_json_parse": """SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN (value + 10.0 + 0.0) / 3 END, 6) AS vmaf, CASE event_id % 4 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS vmaf_min, round(CASE event_id % 4 WHEN 0 THEN 7.0::DOUBLE WHEN 1 THEN greatest(value, 10.0::DOUBLE) END, 6) AS vmaf_max FROM events""",
        "quality_score_mode": f"WITH x AS (SELECT *, {MODE} AS mode FROM lineitem), y AS (SELECT l_orderkey, mode, {QUALITY} AS score FROM x) SELECT l_orderkey, mode, sum(score) AS score, count(*) FILTER (mode = 'none' OR score >= 60) AS n_meets FROM y GROUP BY ALL",
        "quality_loss_verdict": f"""WITH x AS (SELECT *, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE {MODE} END AS mode, CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE l_partkey * 1000 END AS o, l_partkey * 500 + l_suppkey AS n, 100.0::DOUBLE - (l_quantity + 50) AS loss FROM lineitem),
          y AS (SELECT *, (o - n)::DOUBLE / nullif(o, 0) * 100 AS smaller, mode IS NULL OR mode = 'none' AS unchecked FROM x)
          SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CASE WHEN o = 0 THEN false WHEN unchecked THEN true ELSE loss <= 25 END AS acceptable, CASE WHEN o = 0 THEN 'Original size is zero' WHEN unchecked THEN printf('Size reduced by %.1f%% (no quality check)', smaller)
            WHEN loss > 25 THEN printf('Quality loss %.1f%% exceeds max 25.0%%', loss) ELSE printf('Quality loss %.1f%% within limit, size reduced %.1f%%', loss, smaller) END AS reason FROM y""",
        "target_dimensions": f"WITH {STREAMS} {_size()}",
        "upscale_passes": f"""WITH {STREAMS}, x AS (SELECT *, greatest(3840.0::DOUBLE / width, 2160.0::DOUBLE / height) AS scale FROM streams WHERE codec_type = 'video')
          SELECT media_id, idx, CAST(CASE WHEN scale > 1 THEN ceil(ln(scale) / ln(4.0::DOUBLE)) ELSE 1 END AS INTEGER) AS passes, CASE WHEN scale > 1 THEN pow(2.0::DOUBLE, round_even(log2(scale), 0)) ELSE 2.0::DOUBLE END AS last_scale,
          CASE WHEN width < 1920 THEN 'ai' ELSE 'traditional' END AS method, CASE WHEN fps = 0 THEN 2 ELSE CAST(trunc(60.0::DOUBLE / fps) AS INTEGER) END AS factor FROM x""",
        "plan_stages": f"WITH {PLANNED} SELECT media_id, array_to_string(stages, ',') AS stages FROM planned",
        "order_stages": "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'stabilize,denoise_video,upscale,encode' ELSE 'encode,remux,foo' END AS stages FROM orders",
        "should_run_matrix": _matrix(),
        "job_schedule": "SELECT o_orderkey AS job_id, 6 - CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, row_number() OVER (ORDER BY 6 - CAST(left(o_orderpriority, 1) AS INTEGER) DESC, o_orderkey) AS position FROM orders",
        "job_rollup": f"WITH {ROLLUP} SELECT *, n_errors = 0 AS success, CASE WHEN n_errors = 0 THEN 'completed' ELSE 'failed' END AS status FROM rolled",
        "job_rollup_stop": f"""WITH {RESULTS}, k AS (SELECT *, min(ord) FILTER (status = 'failed') OVER (PARTITION BY job_id) AS f, max(ord) OVER (PARTITION BY job_id) AS last FROM results)
          SELECT job_id, count(*) AS n_stages, count(*) FILTER (status = 'failed') AS n_errors, count(*) FILTER (status = 'failed') = 0 AS success, max(CASE WHEN ord = last THEN output_path END) AS output_path FROM k WHERE f IS NULL OR ord <= f GROUP BY 1""",
        "job_input_chain": f"WITH {RESULTS} SELECT job_id, ord, coalesce(last_value(CASE WHEN status <> 'failed' THEN output_path END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), input_path) AS stage_input FROM results",
        "run_summary": f"WITH {ROLLUP} SELECT count(*) AS total, count(*) FILTER (n_errors = 0) AS succeeded, count(*) FILTER (n_errors > 0) AS failed FROM rolled",
        "job_report": f"""WITH {ROLLUP}, l AS (SELECT job_id, string_agg('  ' || CASE status WHEN 'completed' THEN 'OK' WHEN 'skipped' THEN 'SKIP' ELSE 'FAIL' END || ' ' || stage || ': ' || printf('%.1fs', duration_sec), chr(10) ORDER BY ord) AS lines FROM results GROUP BY 1)
          SELECT job_id, '=== Processing Report: ' || job_id || ' ===' || chr(10) || 'Output: ' || coalesce(output_path, 'N/A') || chr(10) || 'Duration: ' || printf('%.1fs', total_duration) || chr(10) || 'Success: ' || CASE WHEN n_errors = 0 THEN 'True' ELSE 'False' END || chr(10) || '--- Stages ---' || chr(10) || lines
            || CASE WHEN skipped <> '' THEN chr(10) || 'Skipped: ' || skipped ELSE '' END || CASE WHEN errors <> '' THEN chr(10) || 'Errors: ' || errors ELSE '' END AS report FROM rolled JOIN l USING (job_id)""",
        "config_merge": _config(),
        "preset_config": _presets(),
        "named_preset": _presets() + " WHERE preset = '4k60'",
        "encoder_select": f"""WITH x AS (SELECT o_orderkey, {_pick(('libx264', 'libx265', 'libvpx-vp9', 'copy'), 'o_custkey')} AS codec, CASE o_orderkey % 3 WHEN 0 THEN ['vaapi', 'cuda'] WHEN 1 THEN ['qsv'] ELSE [] END AS have, {_pick(('auto', 'none', 'QSV', 'vulkan'), 'o_custkey + o_orderkey')} AS wish FROM orders),
          y AS (SELECT *, CASE WHEN wish = 'none' THEN 'none' WHEN wish = 'auto' THEN {_first_acceleration()} WHEN list_contains(have, lower(wish)) THEN lower(wish) ELSE 'none' END AS acceleration FROM x)
          SELECT o_orderkey, acceleration, {_encoder()} AS encoder, CASE WHEN acceleration = 'none' THEN '' ELSE '-hwaccel ' || acceleration END AS arguments, {_fourcc('codec')} AS fourcc FROM y""",
        "loudness_parse": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -23.0::DOUBLE ELSE -value END AS measured_i, CASE WHEN event_id % 5 = 0 THEN -2.0::DOUBLE ELSE -1.5 END AS measured_tp, CASE WHEN event_id % 5 = 0 THEN 7.0::DOUBLE ELSE event_id % 20 END AS measured_lra, -34.0::DOUBLE AS measured_thresh, 0.0::DOUBLE AS target_offset FROM events",
        "loudness_two_pass": "WITH x AS (SELECT event_id, user_id, value / 500.0::DOUBLE AS s FROM events), m AS (SELECT user_id, 20 * log10(sqrt(avg(s * s))) AS l, 20 * log10(max(abs(s))) AS p FROM x GROUP BY 1), g AS (SELECT user_id, least(-23.0::DOUBLE - l, -2.0::DOUBLE - p) AS gain FROM m) SELECT event_id, round(gain, 6) AS gain_db, round(s * pow(10.0::DOUBLE, gain / 20), 6) AS normalised FROM x JOIN g USING (user_id)",
        "speed_retime": f"WITH {FRAMES} SELECT video, event_id, round(t / 1.5::DOUBLE, 6) AS t FROM frames",
        "frame_interpolate": f"""WITH {FRAMES}, p AS (SELECT video, idx, luma, lag(luma) OVER (PARTITION BY video ORDER BY idx) AS prev FROM frames), j AS (SELECT unnest([1, 2]) AS j)
          SELECT video, idx * 3 AS pos, round(luma, 6) AS value FROM frames UNION ALL SELECT video, (idx - 1) * 3 + j, round((1 - j / 3.0::DOUBLE) * prev + j / 3.0::DOUBLE * luma, 6) FROM p, j WHERE idx >= 1""",
        "temporal_denoise": f"WITH {FRAMES} SELECT video, idx, round(avg(luma) OVER (PARTITION BY video ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM frames",
        "progress_parse": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'Processing: ' || lpad((event_id % 24)::VARCHAR, 2, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') || ':' || lpad((event_id % 59)::VARCHAR, 2, '0') || '.25' END AS message, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 400.0::DOUBLE)) AS progress FROM events",
        "complexity": f"WITH {MEDIA} SELECT media_id, greatest(1.0::DOUBLE, width::DOUBLE * height * duration / (1920.0::DOUBLE * 1080 * 60)) AS complexity FROM info",
        "file_checksums": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "model_inventory": _models(),
        "upscale_pixels": f"WITH {SHOTS} SELECT frame, 256 AS n, round(list_sum(px) * 4, 4) AS total, round(px[(37 // 16) // 2 * 8 + (37 % 16) // 2 + 1], 6) AS p37 FROM shots",
        "tonemap_pixels": f"SELECT event_id, round({_hable('value / 50.0::DOUBLE')} / {_hable('11.2::DOUBLE')}, 8) AS mapped FROM events",
        "tta_average": f"WITH {SHOTS} SELECT frame, 64 AS n, round(px[10] * 2, 6) AS p9 FROM shots",
        "ssim_log_parse": "WITH x AS (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS v FROM events) SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN (event_id % 7) / 8.0::DOUBLE ELSE (v + 1.25) / 3 END, 6) AS ssim, least(v, 0.5) AS ssim_min, greatest(v, 0.75) AS ssim_max FROM x",
        "config_layers": _layers(),
        "stage_overrides": f"""WITH {RESULTS}, o AS (SELECT o_orderkey AS job_id, {_pick(T.STAGE_ORDER, 'o_custkey')} AS stage, 'factor=' || o_custkey % 4 || ';strength=high' AS options FROM orders)
          SELECT r.job_id, ord, r.stage, coalesce(options, '') AS options FROM results r LEFT JOIN o ON o.job_id = r.job_id AND o.stage = r.stage""",
        "queue_run": f"""WITH {ROLLUP}, q AS (SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY 6 - CAST(left(o_orderpriority, 1) AS INTEGER) DESC, o_orderkey) AS position FROM orders)
          SELECT q.job_id, position, q.job_id % 13 <> 0 AND coalesce(n_errors, 0) = 0 AS success, CASE WHEN q.job_id % 13 = 0 THEN 'no such input: ' || q.job_id ELSE coalesce(errors, '') END AS errors, q.job_id % 13 <> 0 AS told FROM q LEFT JOIN rolled USING (job_id) WHERE position < 1200""",
        "encode_commands": f"""WITH x AS (SELECT o_orderkey, o_custkey, {_pick(('libx264', 'libx265', 'libvpx-vp9', 'copy'), 'o_custkey')} AS codec, {_pick(('none', 'cuda', 'qsv'), 'o_orderkey')} AS acceleration FROM orders)
          SELECT o_orderkey, CASE WHEN acceleration = 'none' THEN '' ELSE '-hwaccel ' || acceleration || ' ' END || '-i /in/' || o_orderkey || ' -c:v ' || {_encoder()} || ' -preset medium -crf ' || o_custkey % 30 || ' -c:a aac -b:a 192k' || CASE WHEN o_orderkey % 5 = 0 THEN ' -vf hqdn3d=4:3:6:6' ELSE '' END
            || ' -y ' || CASE WHEN o_orderkey % 2 = 0 THEN '/out/' ELSE '/in/' END || o_orderkey AS arguments FROM x""",
        "error_texts": f"WITH x AS (SELECT event_id, {_pick(('encode', 'upscale', 'denoise_video', 'hdr'), 'event_id')} AS stage, repeat('failed: ' || event_id || '; ', 150) AS e FROM events) SELECT event_id, stage, left(e, CASE stage WHEN 'encode' THEN 500 WHEN 'upscale' THEN 2000 WHEN 'denoise_video' THEN 200 ELSE length(e) END) AS error FROM x",
        "file_fallbacks": f"WITH {MEDIA} SELECT media_id, CASE WHEN media_id % 3 = 0 THEN 0.0::DOUBLE ELSE duration END AS duration, CASE WHEN media_id % 2 = 0 THEN media_id * 1000 ELSE 0 END AS size_bytes FROM info",
        "model_cache_clear": f"""WITH {MODEL_FILES}, c AS (SELECT filename FROM listed WHERE dir = '/cache')
          SELECT name, CASE WHEN filename IN (SELECT filename FROM c) THEN 1 ELSE 0 END::BIGINT AS removed FROM (VALUES {', '.join(f"('{m[0]}', '{m[1]}')" for m in T.MODELS)}) t(name, filename) UNION ALL SELECT '*', count(*) FROM c""",
        "stabilise_scene_counts": f"""WITH {SHOTS}, p AS (SELECT video, frame, px, lag(px) OVER (PARTITION BY video ORDER BY frame) AS q FROM shots), u AS (SELECT video, frame, unnest(px) AS x, unnest(q) AS y FROM p WHERE q IS NOT NULL),
          c AS (SELECT video, count(*) AS n FROM (SELECT video, frame, round(corr(x, y), 8) AS r FROM u GROUP BY ALL) WHERE r < {T.CORRELATION_CUT} GROUP BY 1) SELECT video, coalesce(n, 0) + 1 AS num_scenes FROM (SELECT DISTINCT video FROM shots) LEFT JOIN c USING (video)""",
        "stabilise_shifts": f"""WITH {VECTORS}, f AS (SELECT video, frame, avg(dx::DOUBLE) AS mx, avg(dy::DOUBLE) AS my FROM vectors GROUP BY ALL), p AS (SELECT video, frame, sum(mx) OVER w AS x, sum(my) OVER w AS y FROM f WINDOW w AS (PARTITION BY video ORDER BY frame))
          SELECT video, frame, round(avg(x) OVER w - x, 6) AS shift_x, round(avg(y) OVER w - y, 6) AS shift_y FROM p WINDOW w AS (PARTITION BY video ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
        "spatial_denoise": f"""WITH {SHOTS}, u AS (SELECT frame, generate_subscripts(px, 1) - 1 AS i, unnest(px) AS x FROM shots), m AS (SELECT a.frame, a.i, avg(b.x) AS y FROM u a JOIN u b ON a.frame = b.frame AND abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1 GROUP BY ALL)
          SELECT frame, round(max(y) FILTER (i = 0), 6) AS p0, round(max(y) FILTER (i = 9), 6) AS p9, round(max(y) FILTER (i = 63), 6) AS p63, round(sum(y), 4) AS total FROM m GROUP BY 1""",
        "deblock_frames": f"WITH {SHOTS} SELECT frame, 'passthrough' AS method, round(list_sum(px), 4) AS total FROM shots",
        "upscale_chain": f"WITH {SHOTS} SELECT frame, 4096 AS n, round(list_sum(px) * 64, 3) AS total, round(px[(1000 // 64) // 8 * 8 + (1000 % 64) // 8 + 1], 6) AS p1000 FROM shots",
        "plugin_chain": "SELECT event_id, round(CASE WHEN value < 100 THEN value * 1.5::DOUBLE ELSE value END, 6) AS luma, CASE WHEN value < 100 THEN value * 1.5::DOUBLE ELSE value END < 50 AS dark FROM events",
        "model_devices": f"""SELECT o_orderkey, CASE WHEN wish IN ('auto', 'cuda') AND o_orderkey % 3 = 0 THEN 'cuda' WHEN wish = 'auto' AND o_orderkey % 3 = 1 THEN 'mps' WHEN wish = 'mps' AND o_orderkey % 3 < 2 THEN 'mps' ELSE 'cpu' END AS device,
          CASE kind WHEN 'fp16' THEN 'float16' WHEN 'bf16' THEN 'bfloat16' ELSE 'float32' END AS dtype
          FROM (SELECT o_orderkey, {_pick(("auto", "cuda", "mps", "cpu", "tpu"), "o_custkey")} AS wish, {_pick(("fp16", "fp32", "bf16", "int8"), "o_orderkey")} AS kind FROM orders)""",
        "queued_jobs": "SELECT o_orderkey, o_orderkey % 7 <> 0 AND o_custkey % 4 = 0 AS is_queued FROM orders",
        "frame_times": f"WITH {FRAMES} SELECT video, idx, event_id, round(CASE WHEN video % 3 = 0 THEN idx::DOUBLE WHEN idx < 8 THEN t ELSE 0.0::DOUBLE END, 6) AS t FROM frames",
        "frame_tags": "SELECT event_id, CASE WHEN value > 150 THEN '1 tags' WHEN value < 50 THEN '2 tags' ELSE '0 tags' END AS summary, CASE WHEN value > 150 THEN 'bright' WHEN value < 50 THEN 'dark,low' ELSE '' END AS tags FROM events",
    }
