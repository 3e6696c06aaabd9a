"""Cutting a plan from its lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` by a reliable checkpoint in ``spark.checkpoint.dir``; only a local master may go without that setting."""
    context = rows.sparkSession.sparkContext
    folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="framelake-"))
    return rows.checkpoint(eager=True)
