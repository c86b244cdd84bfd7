"""Retries and caches as tables: what is tried again and when, what is left of a broken-off job, what is known already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import classify_error

BACKOFF_SECONDS = [30, 180]


def scheduled(failures: DataFrame, tries: int = 2) -> DataFrame:
    """Failed jobs that are tried again, with ``scheduled_at`` (seconds): only retryable errors below the number of tries."""
    again = (F.col("attempts") < tries) & classify_error(F.col("message"))["retryable"]
    wait = F.element_at(F.array(*map(F.lit, BACKOFF_SECONDS)), F.least(F.greatest(F.col("attempts"), F.lit(1)), F.lit(len(BACKOFF_SECONDS))).cast("int"))
    return failures.where(again).withColumn("scheduled_at", F.col("failed_at") + wait)


def chunked(ids: DataFrame, order: str, size: int = 100) -> DataFrame:
    """Ids with the number of their chunk."""
    from pyspark.sql import Window

    return ids.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("owner").orderBy(order)) - 1) / size))


def remainder(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of chunks (owner, chunk) that did not succeed."""
    return chunks.join(done.select("owner", "chunk"), ["owner", "chunk"], "left_anti")


def cached(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests with the result of the latest completed run of the same update, provider, model and prompt."""
    keys = ["telegram_update_id", "provider", "model", "prompt"]
    known = runs.where("status = 'completed'").groupBy(*keys).agg(F.max_by("result", "id").alias("cached_result"))
    return requests.join(known, keys, "left")


def retryable_job(jobs: DataFrame, uuid: Column) -> DataFrame:
    """The failed job of an id, if there is one."""
    return jobs.where(F.col("uuid") == uuid).limit(1)
