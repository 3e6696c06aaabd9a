"""The corpus pipeline: language ID, near-dedup, passage dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of ``documents``.

* language_id drops documents that have no language: those without any letter,
  and those less like their nearest language than texts of their length are.
* near_dedup leaves one document of each group of linked near copies, the one
  with the smallest id. SimHash links and min-hash bands propose candidates, which
  are linked if the exact Jaccard similarity of their five-word shingles is at
  least 0.8. Of rows that share id and text one stays, whatever else they hold.
* passage_dedup cuts byte strings of 100 bytes that start earlier in the corpus.
  Bytes of a character that was cut in part go as well; documents of which
  nothing is left go. ``n_chars`` is set to the new length.
* decontaminate drops documents with a 10-word passage of the benchmark.
* tokens encodes the texts and decodes them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake import ship
from framelake.llm import bytebpe, decontam, langid, passages, similar
from framelake.llm.common import read_table, spread, tidy, written


def ready(spark: SparkSession) -> None:
    """What each stage begins with: executors have the package, and nothing that the stage before left in their heaps."""
    ship(spark)
    tidy(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = spread(docs)
    judged = docs.withColumn("__judged", langid.learned_judge(docs)(F.col("text")))
    return judged.where(~langid.rejected(F.col("__judged.lang_pred"), F.col("__judged.score"), F.col("__judged.least"))).drop("__judged")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    kind = f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},h:bigint>"  # nullable fields on both sides: one shuffle serves both steps below
    marked = docs.withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("h")).cast(kind))
    groups = similar.near_duplicates(marked, "__key", "text")
    first = groups.where(F.col("__key") == F.col("component_id")).select("component_id").distinct()
    # rows that repeat one another share a key (a struct, never null); one of them stays, without a second shuffle
    return marked.join(first, F.col("__key") == F.col("component_id"), "left_semi").dropDuplicates(["__key"]).drop("__key")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = passages.remove_repeats(docs, keep=others, as_text=True)

    texts = cut.where((F.length("kept") > 0) | (F.col("n_removed") == 0))
    columns = {"doc_id": F.col("doc"), "text": F.col("kept")} | {c: F.col("rest")[c] for c in others}
    columns["n_chars"] = F.length("kept").cast("long")
    return texts.select(*(columns[c].alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    others = tuple(c for c in docs.columns if c != "doc_id")
    judged = decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), keep=others)
    return judged.where(~F.col("contaminated")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return bytebpe.round_trip(docs, keep=("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: SQL cannot express the learned, iterative and tokenising stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
