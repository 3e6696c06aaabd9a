"""Plug-in stages: named DataFrame transforms with a predicate, and pluggable taggers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans.lineage import cut


@dataclass(frozen=True)
class Stage:
    """``columns`` gives new values of columns for the rows picked; a stage without it is a transform ``apply`` of whole rows."""

    name: str
    apply: Callable[[DataFrame], DataFrame] | None
    applies_to: Callable[[], Column]
    category: str = "enhancement"
    priority: int = 50
    columns: Callable[[], dict[str, Column]] | None = None


REGISTRY: dict[str, Stage] = {}


def register_stage(name: str, applies_to: Callable[[], Column] | None = None, category: str = "enhancement", priority: int = 50):
    """A decorator for DataFrame -> DataFrame functions; ``applies_to`` picks the rows that the stage changes."""

    def add(apply: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        REGISTRY[name] = Stage(name, apply, applies_to or (lambda: F.lit(True)), category, priority)
        return apply

    return add


def register_columns(name: str, applies_to: Callable[[], Column] | None = None, category: str = "enhancement", priority: int = 50):
    """A decorator for functions that return new values by column name: such a stage is a projection."""

    def add(columns: Callable[[], dict[str, Column]]) -> Callable[[], dict[str, Column]]:
        REGISTRY[name] = Stage(name, None, applies_to or (lambda: F.lit(True)), category, priority, columns)
        return columns

    return add


def run_chain(rows: DataFrame, names: list[str], progress: Callable[[float, str], None] | None = None, job_done: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, list[str]]:
    """Applies stages in order to the rows that they pick; unknown names are skipped and returned.

    A stage of columns stays one projection over its input. Before a stage of
    whole rows, which parts them from the others, the plan is cut by a
    checkpoint, so the chain is read once however many stages it has.
    """
    skipped, whole = [], False
    for i, name in enumerate(names):
        stage = REGISTRY.get(name)
        if stage is None:
            skipped.append(name)
            continue
        picked = F.coalesce(stage.applies_to(), F.lit(False))
        if stage.columns is not None:
            made = {c: F.when(picked, new).otherwise(F.col(c)) if c in rows.columns else F.when(picked, new) for c, new in stage.columns().items()}
            rows = rows.withColumns(made)
        else:
            rows = cut(rows) if whole else rows
            rows, whole = stage.apply(rows.where(picked)).unionByName(rows.where(~picked), allowMissingColumns=True), True
        if progress:
            progress(min(1.0, max(0.0, (i + 1) / len(names))), name)
    if job_done:
        job_done(rows)
    return rows, skipped


TAGGERS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def tag_frames(frames: DataFrame, provider: str, key: str = "video") -> DataFrame:
    """(key, summary, tags) by a registered tagger; an unknown provider tags nothing."""
    tagger = TAGGERS.get(provider)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield tagger(batch) if tagger else pd.DataFrame({key: pd.Series(dtype=object), "summary": pd.Series(dtype=object), "tags": pd.Series(dtype=object)})

    return frames.mapInPandas(run, f"{key} {frames.schema[key].dataType.simpleString()}, summary string, tags array<string>")
