"""Word lists, lookup tables and constants that results depend on."""

from __future__ import annotations

# File name extensions.
VIDEO_EXTENSIONS = (".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg", ".3gp", ".ogv", ".ts", ".vob", ".rm", ".rmvb", ".asf", ".f4v", ".mxf")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")

# Colour transfers of HDR video, codecs without blocking, container names that ask for a remux.
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
CLEAN_CODECS = ("prores", "dnxhd", "hqx")
REMUX_FORMATS = ("matroska", "mkv")

# The canonical order of stages, and those that are planned unless disabled.
STAGE_ORDER = ("detect", "stabilize", "deblock", "denoise_video", "upscale", "interpolate", "normalize_volume", "normalize_audio", "speed", "hdr", "encode")
ALWAYS_ON = ("stabilize", "denoise_video", "deblock", "normalize_volume", "normalize_audio")

# Registered stages as (name, category, priority, gpu).
STAGES = (
    ("detect", "analysis", 1, False),
    ("stabilize", "enhancement", 10, False),
    ("deblock", "enhancement", 15, False),
    ("denoise_video", "enhancement", 20, True),
    ("upscale", "enhancement", 30, True),
    ("interpolate", "enhancement", 35, True),
    ("normalize_audio", "enhancement", 40, False),
    ("normalize_volume", "enhancement", 40, False),
    ("speed", "enhancement", 50, False),
    ("hdr", "enhancement", 60, False),
    ("remux", "output", 80, False),
    ("encode", "encoding", 90, False),
)

# Software codec -> acceleration -> hardware codec.
HARDWARE_CODECS = {
    "libx264": {"cuda": "h264_nvenc", "vaapi": "h264_vaapi", "qsv": "h264_qsv", "videotoolbox": "h264_videotoolbox"},
    "libx265": {"cuda": "hevc_nvenc", "vaapi": "hevc_vaapi", "qsv": "hevc_qsv", "videotoolbox": "hevc_videotoolbox"},
    "libvpx-vp9": {"vaapi": "vp9_vaapi", "qsv": "vp9_qsv"},
    "libvpx": {"vaapi": "vp8_vaapi"},
}
# Preference of accelerations.
ACCELERATIONS = ("cuda", "vaapi", "qsv", "videotoolbox", "d3d11", "vulkan")
# Preference of devices for models before the CPU, and number formats by their short names; others read as float32.
DEVICES = ("cuda", "mps")
DTYPES = {"fp16": "float16", "fp32": "float32", "bf16": "bfloat16"}
# Codec -> fourcc; the default is H264.
FOURCC = {"libx264": "H264", "libx265": "H265", "mpeg4": "XVID", "h264": "H264", "h265": "H265", "vp8": "VP80", "vp9": "VP90"}
# Denoise strengths as luma and chroma, spatial and temporal; unknown reads as medium.
DENOISE = {"low": (4, 3, 6, 6), "medium": (6, 4, 8, 8), "high": (10, 6, 12, 12)}

_ALL_ON = ("detect", "stabilize", "deblock", "denoise_video", "upscale", "interpolate", "normalize_volume", "normalize_audio", "encode")
# Characters that are kept of a stage's error text.
ERROR_LENGTHS = {"denoise_video": 200, "stabilize": 200, "encode": 500, "upscale": 2000}

# Presets as (name, width, height, fps, video codec, audio codec, crf, speed, stages on, stages off).
PRESETS = (
    ("max_quality", 3840, 2160, 60.0, "libx264", "aac", 12, "slower", _ALL_ON, ()),
    ("4k60", 3840, 2160, 60.0, "libx264", "aac", 18, "medium", _ALL_ON, ()),
    ("4k30", 3840, 2160, 30.0, "libx264", "aac", 18, "medium", tuple(s for s in _ALL_ON if s != "interpolate"), ()),
    ("1080p60", 1920, 1080, 60.0, "libx264", "aac", 20, "medium", _ALL_ON, ()),
    ("size_reduction", None, None, None, "libx264", "aac", 28, "fast", ("detect", "normalize_volume", "normalize_audio", "encode"), ("stabilize", "deblock", "denoise_video", "upscale", "interpolate")),
    ("remux_only", None, None, None, "copy", "copy", 18, "medium", ("detect", "remux"), ("encode",)),
    ("hdr_enhance", None, None, None, "libx265", "aac", 22, "medium", ("detect", "hdr", "stabilize", "denoise_video", "normalize_volume", "normalize_audio", "encode"), ()),
)

# Models as (name, file name, MB, description, scale).
MODELS = (
    ("RealESRGAN_x4plus", "RealESRGAN_x4plus.pth", 65, "Real-ESRGAN x4 upscaling model", 4),
    ("RealESRGAN_x2plus", "RealESRGAN_x2plus.pth", 65, "Real-ESRGAN x2 upscaling model", 2),
    ("RealESRGAN_x4plus_anime_6B", "RealESRGAN_x4plus_anime_6B.pth", 19, "Real-ESRGAN x4 anime model (lighter, 6 RRDB blocks)", 4),
    ("rife_v4.6", "rife_v4.6.pkl", 40, "RIFE v4.6 frame interpolation model", None),
    ("rife_v4.11", "rife_v4.11.pkl", 40, "RIFE v4.11 frame interpolation model", None),
)

# Defaults of the analytic parameters.
SCENE_THRESHOLD, MIN_SCENE_SECONDS = 0.3, 2.0
SIMILARITY_THRESHOLD, CORRELATION_CUT = 0.95, 0.98
SHAKE_THRESHOLD, SIGNIFICANT_SHIFT, SIGNIFICANT_SHARE, OUTLIER_FACTOR = 2.0, 2.0, 0.5, 3.0
ZOOM_THRESHOLD, ZOOM_GAIN, ZOOM_LIMIT = 50.0, 0.75, 20.0
TARGET_LOUDNESS, TRUE_PEAK, LOUDNESS_RANGE, LOUDNESS_THRESHOLD = -23.0, -2.0, 7.0, -34.0

#: Default configuration as key paths; what is absent here is absent by default.
DEFAULT_CONFIG = (
    ("general.max_concurrent_jobs", "1"), ("general.log_level", "INFO"), ("general.overwrite", "false"),
    ("ffmpeg.hwaccel", "auto"), ("ffmpeg.threads", "0"),
    ("quality.quality_target.mode", "none"), ("quality.quality_target.target", "95.0"), ("quality.quality_target.max_loss_pct", "5.0"), ("quality.quality_target.keep_aspect_ratio", "true"),
    ("pipeline.skip_stage_on_error", "true"),
    ("stages.upscale.enabled", "true"), ("stages.interpolate.enabled", "true"), ("stages.denoise_video.enabled", "true"), ("stages.deblock.enabled", "true"), ("stages.stabilize.enabled", "true"), ("stages.normalize_volume.enabled", "true"),
    ("stages.hdr_to_sdr.enabled", "false"), ("stages.speed.enabled", "false"), ("stages.speed.factor", "1.0"),
    ("analysis.event_detection.scene_change_threshold", "0.3"), ("analysis.event_detection.min_scene_duration_sec", "2.0"),
    ("analysis.duplicate_detection.similarity_threshold", "0.95"),
)
