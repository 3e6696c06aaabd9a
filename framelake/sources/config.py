"""Configuration: YAML and JSON files, flattened key paths, layered merges, presets."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T


def flatten(tree: dict[str, Any], above: str = "") -> list[tuple[str, str | None]]:
    """Leaves as (key path, JSON-like text); lists are leaves, an explicit null is a row with a null value."""
    out: list[tuple[str, str | None]] = []
    for key, value in tree.items():
        path = f"{above}.{key}" if above else str(key)
        if isinstance(value, dict) and value:
            out += flatten(value, path)
        else:
            out.append((path, None if value is None else value if isinstance(value, str) else json.dumps(value)))
    return out


def load_yaml(path: str) -> dict[str, Any]:
    """A YAML file as a tree; an unreadable or odd one counts as empty."""
    try:
        import yaml

        tree = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        return tree if isinstance(tree, dict) else {}
    except Exception:  # noqa: BLE001 any fault of the file means the defaults
        return {}


def save_yaml(tree: dict[str, Any], path: str) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump(tree, sort_keys=False), encoding="utf-8")


def nested_get(tree: dict[str, Any], *keys: str, default: Any = None) -> Any:
    """A value by its path; the default if the path ends early. An explicit null is returned as such."""
    at: Any = tree
    for key in keys:
        if not isinstance(at, dict) or key not in at:
            return default
        at = at[key]
    return at


def nested_set(tree: dict[str, Any], value: Any, *keys: str) -> None:
    for key in keys[:-1]:
        tree = tree.setdefault(key, {})
    tree[keys[-1]] = value


def config_table(spark: SparkSession, rows: list[tuple[str, str | None]]) -> DataFrame:
    return spark.createDataFrame(rows, "path string, value string")


def merge(base: DataFrame, over: DataFrame) -> DataFrame:
    """Key paths of both; where both have one, ``over`` holds, even if it is null."""
    b = base.select("path", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    o = over.select("path", F.col("value").alias("o"), F.lit(True).alias("in_o"))
    return b.join(o, "path", "full_outer").select("path", F.when(F.col("in_o"), F.col("o")).otherwise(F.col("b")).alias("value"), F.when(F.col("in_o"), "override").otherwise("default").alias("origin"))


def layered(layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """(path, value, origin) of several layers, the later over the earlier, leaf by leaf.

    A leaf of a later layer also replaces the subtree under its path, and a
    subtree the leaf above it.
    """
    rows = reduce(DataFrame.unionByName, [t.select("path", "value", F.lit(i).alias("layer"), F.lit(n).alias("origin")) for i, (n, t) in enumerate(layers)])
    parts = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    above = rows.where(F.size(parts) > 1).select("path", "layer", F.explode(prefixes).alias("p"))
    under_leaf = above.join(rows.select(F.col("path").alias("p"), F.col("layer").alias("later")), "p").where(F.col("later") > F.col("layer")).select("path", "layer")
    over_subtree = rows.join(above.select(F.col("p").alias("path"), F.col("layer").alias("later")), "path").where(F.col("later") > F.col("layer")).select("path", "layer")
    left = rows.join(under_leaf.union(over_subtree).distinct(), ["path", "layer"], "left_anti")
    return left.groupBy("path").agg(F.max_by(F.struct("value", "origin"), "layer").alias("x")).select("path", "x.value", "x.origin")


def save_if_pending(tree: dict[str, Any], path: str, pending: bool) -> bool:
    """Saves a changed configuration; tells whether it did."""
    if pending:
        save_yaml(tree, path)
    return pending


def preset(table: DataFrame, name: str) -> DataFrame:
    """The preset of a name; no row if there is none."""
    return table.where(F.col("name") == name)


def replace_sections(base: DataFrame, over: DataFrame) -> DataFrame:
    """The shallow variant: a top section that ``over`` names is replaced as a whole."""
    top = F.split("path", r"\.")[0].alias("top")
    named = over.select(top).distinct()
    return base.withColumn("top", top).join(F.broadcast(named), "top", "left_anti").select("path", "value").unionByName(over.select("path", "value"))


PRESET_SCHEMA = "name string, target_w int, target_h int, fps double, video_codec string, audio_codec string, crf int, speed string, stages_on array<string>, stages_off array<string>"


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*p[:8], list(p[8]), list(p[9])) for p in T.PRESETS], PRESET_SCHEMA)


def save_presets(table: DataFrame, folder: str) -> None:
    table.write.mode("overwrite").json(folder)


def load_presets(spark: SparkSession, folder: str) -> DataFrame:
    """Presets from JSON lines; what does not parse is dropped."""
    return spark.read.schema(PRESET_SCHEMA).option("mode", "DROPMALFORMED").json(folder)


def preset_config(table: DataFrame) -> DataFrame:
    """(preset, path, value): each preset as key paths; a quality target only with a resolution."""
    quality = F.when(F.col("target_w").isNotNull(), F.array(
        F.struct(F.lit("quality.quality_target.mode").alias("path"), F.lit("target").alias("value")),
        F.struct(F.lit("quality.quality_target.target").alias("path"), F.col("crf").cast("string").alias("value")),
        F.struct(F.lit("quality.quality_target.target_resolution").alias("path"), F.format_string("[%d, %d]", "target_w", "target_h").alias("value")),
        F.struct(F.lit("quality.quality_target.target_framerate").alias("path"), F.col("fps").cast("string").alias("value")),
    )).otherwise(F.from_json(F.lit("[]"), "array<struct<path:string,value:string>>"))
    switch = lambda c, v: F.transform(c, lambda s: F.struct(F.concat(F.lit("stages."), s, F.lit(".enabled")).alias("path"), F.lit(v).alias("value")))
    coding = F.array(*[F.struct(F.lit(f"encoding.{k}").alias("path"), F.col(c).cast("string").alias("value")) for k, c in (("video_codec", "video_codec"), ("audio_codec", "audio_codec"), ("crf", "crf"), ("preset", "speed"))])
    return table.select(F.col("name").alias("preset"), F.explode(F.concat(quality, switch("stages_on", "true"), switch("stages_off", "false"), coding)).alias("x")).select("preset", "x.path", "x.value")
