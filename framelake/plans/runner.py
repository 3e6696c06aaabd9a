"""Outcome of jobs from their stage results: inputs by stage, roll-up, summary, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def input_chain(results: DataFrame, job: str = "job_id", original: str = "input_path") -> DataFrame:
    """Adds stage_input: the latest earlier output of a stage that did not fail, else the job's input."""
    before = Window.partitionBy(job).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("status") != "failed", F.col("output_path"))
    return results.withColumn("stage_input", F.coalesce(F.last(good, ignorenulls=True).over(before), F.col(original)))


def stopped(results: DataFrame, job: str = "job_id") -> DataFrame:
    """Only the stages up to a job's first failure."""
    failures = results.where("status = 'failed'").groupBy(F.col(job).alias("__j")).agg(F.min("ord").alias("__f"))
    return results.join(failures, F.col(job) == F.col("__j"), "left").where(F.col("__f").isNull() | (F.col("ord") <= F.col("__f"))).drop("__j", "__f")


#: Messages of one kind, and lines, that a job's texts list; the counts beside them are of all.
LISTED = 1000


def leading(results: DataFrame, job: str, kind: Column, listed: int) -> DataFrame:
    """The first ``listed`` rows of each job and kind by ord; Spark limits within tasks before the shuffle."""
    order = Window.partitionBy(job, kind).orderBy("ord")
    return results.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= listed).drop("__r")


def rollup(results: DataFrame, job: str = "job_id", stop_on_error: bool = False, listed: int = LISTED) -> DataFrame:
    """One row per job: success, status, counts, errors and skipped in order, total seconds, the output of the last listed stage.

    The output is null if the last listed stage has none, even though the job
    succeeded. The texts list up to ``listed`` messages each; only those are gathered.
    """
    last = results.groupBy(F.col(job).alias("__j")).agg(F.max("ord").alias("__last"))
    ran = stopped(results, job) if stop_on_error else results
    joined_text = lambda cond, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", text.alias("m"))))), lambda s: s["m"]), "; ")
    failed, skipped = F.col("status") == "failed", F.col("status") == "skipped"
    out = ran.groupBy(job).agg(
        F.count("*").alias("n_stages"), F.count_if(failed).alias("n_errors"), F.count_if(skipped).alias("n_skipped"), F.sum("duration_sec").alias("total_duration"),
        F.max_by(F.struct("ord", "output_path"), "ord").alias("__end"),
    )
    told = leading(ran.where(failed | skipped), job, F.col("status"), listed).groupBy(F.col(job).alias("__k")).agg(
        joined_text(failed, F.concat("stage", F.lit(": "), "error")).alias("errors"), joined_text(skipped, F.col("stage")).alias("skipped"))
    joined = out.join(last, F.col(job) == F.col("__j")).join(told, F.col(job) == F.col("__k"), "left").fillna("", ["errors", "skipped"])
    return joined.withColumns({
        "success": F.col("n_errors") == 0, "status": F.when(F.col("n_errors") == 0, "completed").otherwise("failed"),
        "output_path": F.when(F.col("__end.ord") == F.col("__last"), F.col("__end.output_path")),
    }).drop("__j", "__k", "__last", "__end")


def with_overrides(stages: DataFrame, overrides: DataFrame, job: str = "job_id") -> DataFrame:
    """Adds options: the overrides (job, stage, options map) of each job's stage; an empty map without."""
    return stages.join(overrides.select(job, "stage", "options"), [job, "stage"], "left").withColumn("options", F.coalesce("options", F.create_map().cast("map<string,string>")))


def execute_all(jobs: DataFrame, results: DataFrame, raised: DataFrame, cancelled_from: int | None = None, job: str = "job_id") -> DataFrame:
    """(job, position, success, errors, told): the outcome of a queue in its order.

    ``jobs`` has position (``planner.schedule``). A job in ``raised`` (job, error)
    has that error alone, and its completion is not told to the callback. From
    position ``cancelled_from`` on nothing runs.
    """
    due = jobs if cancelled_from is None else jobs.where(F.col("position") < cancelled_from)
    outcome = rollup(results, job).select(job, F.col("success").alias("__s"), F.col("errors").alias("__e"))
    joined = due.select(job, "position").join(outcome, job, "left").join(raised.select(job, F.col("error").alias("__x")), job, "left")
    failed = F.col("__x").isNotNull()
    return joined.select(job, "position", (~failed & F.coalesce("__s", F.lit(True))).alias("success"), F.coalesce("__x", "__e", F.lit("")).alias("errors"), (~failed).alias("told"))


def is_queued(status: Column) -> Column:
    """Whether a job has not begun; a null status is none."""
    return F.coalesce(status == "idle", F.lit(False))


def summary(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("success")).alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def size_ratio(jobs: DataFrame) -> DataFrame:
    """Adds size_ratio of output to input; 0.0 without an input size."""
    return jobs.withColumn("size_ratio", F.coalesce(F.col("output_size") / F.nullif(F.col("input_size").cast("double"), F.lit(0.0)), F.lit(0.0)))


def report(results: DataFrame, job: str = "job_id", listed: int = LISTED) -> DataFrame:
    """(job, report): a text of the outcome with a line for each of the first ``listed`` stages."""
    line = F.concat(F.lit("  "), S.status_icon(F.col("status")), F.lit(" "), F.col("stage"), F.lit(": "), S.one_decimal(F.col("duration_sec")), F.lit("s"))
    lines = leading(results, job, F.lit(0), listed).groupBy(F.col(job).alias("__j")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("m")))), lambda s: s["m"]), "\n").alias("lines"))
    jobs = rollup(results, job, listed=listed)
    head = F.concat_ws(
        "\n", F.concat(F.lit("=== Processing Report: "), F.col(job).cast("string"), F.lit(" ===")), F.concat(F.lit("Output: "), F.coalesce("output_path", F.lit("N/A"))),
        F.concat(F.lit("Duration: "), S.one_decimal(F.col("total_duration")), F.lit("s")), F.concat(F.lit("Success: "), F.when(F.col("success"), "True").otherwise("False")), F.lit("--- Stages ---"), F.col("lines"),
    )
    tail = F.concat(F.when(F.col("skipped") != "", F.concat(F.lit("\nSkipped: "), "skipped")).otherwise(""), F.when(F.col("errors") != "", F.concat(F.lit("\nErrors: "), "errors")).otherwise(""))
    return jobs.join(lines, F.col(job) == F.col("__j")).select(job, F.concat(head, tail).alias("report"))


def progress(results: DataFrame, job: str = "job_id", part: str | None = None) -> DataFrame:
    """Adds is_last and overall: how far a job is within its listed stages when a stage is ``part`` (0 to 1) done."""
    totals = results.groupBy(F.col(job).alias("__j")).agg(F.count("*").alias("__n"), F.min("ord").alias("__f"), F.max("ord").alias("__l"))
    joined = results.join(totals, F.col(job) == F.col("__j"))
    done = S.clamp(F.col(part)) if part else F.lit(1.0)
    return joined.withColumns({"is_last": F.col("ord") == F.col("__l"), "overall": (F.col("ord") - F.col("__f") + done) / F.col("__n")}).drop("__j", "__n", "__f", "__l")


def final_status(jobs: DataFrame, cancelled: str | None = None) -> DataFrame:
    """Adds status: cancelled if that was asked for, else completed or failed."""
    done = F.when(F.col("success"), "completed").otherwise("failed")
    return jobs.withColumn("status", done if cancelled is None else F.when(F.col(cancelled), "cancelled").otherwise(done))
