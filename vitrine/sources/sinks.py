"""Writers: appends, idempotent batches, content-named files and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.numbers import content_name


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """A batch below its own folder: writing it again replaces it."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def queue_split(path: str, queues: list[str]):
    """A ``foreachBatch`` function that sends each row to its queue's folder."""

    def write(batch: DataFrame, number: int) -> None:
        routed = batch.withColumn("queue", F.when(F.col("queue").isin(queues), F.col("queue")).otherwise("default"))
        routed.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("queue", "batch").parquet(path)

    return write


def named_contents(rows: DataFrame, role: str = "role", data: str = "data") -> DataFrame:
    """Binary contents with the name they are stored under."""
    return rows.withColumn("name", content_name(F.col(role), F.col(data)))


def json_document(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
