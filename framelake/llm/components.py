"""Connected components of a graph of many small and some large components, by contraction.

In each round every vertex points to its least neighbour (or itself), edges move
to where their ends point, and loops vanish. Vertex ids should be mixed (their
order unrelated to the graph), which makes the rounds logarithmic. Each round
runs at once and is cut from its lineage by tables in the shared folder, of which
only the last round's stay; nothing but row counts comes to the driver. Minima
are pre-aggregated, so a vertex of many edges costs no more than a row per task
in the shuffle of its minimum; its joins are split by Spark's adaptive skew
handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b); loops and repeated edges do no harm."""
    tidy = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(tidy(edges), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        step = written(both.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("root")), "pointers")
        moved = edges.join(step.select(F.col("v").alias("a"), F.col("root").alias("pa")), "a").join(step.select(F.col("v").alias("b"), F.col("root").alias("pb")), "b")
        after = written(tidy(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
        forget(edges)
        edges = after
        if roots is None:
            roots = step
        else:
            further = written(roots.join(step.select(F.col("v").alias("root"), F.col("root").alias("p")), "root", "left").select("v", F.coalesce("p", "root").alias("root")), "roots")
            forget(roots, step)
            roots = further
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")) if roots is None else roots
