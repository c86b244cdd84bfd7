"""What a draft must not get again: addresses of pictures, addresses of pages and picture hashes, gathered over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.selection import without_near_duplicates
from vitrine.session import folder_exists

KINDS = ("image", "source", "hash")
_SCHEMA = "draft_id long, kind string, value string, high long, low long"


class Exclusions:
    """A growing set of (draft_id, kind, value or hash) in a folder, one part for each batch.

    A batch is written under its name, so one that is sent again replaces itself; the set is the distinct union of all
    batches. ``compact`` writes it as one batch when there are many. Addresses are trimmed, empty ones left out.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, batch: str, addresses: DataFrame | None = None, hashes: DataFrame | None = None) -> Exclusions:
        """Exclude ``addresses`` (draft_id, kind, value) and ``hashes`` (draft_id, high, low)."""
        rows = self.spark.createDataFrame([], _SCHEMA)
        if addresses is not None:
            value = F.trim("value")
            rows = rows.unionByName(addresses.where(F.col("kind").isin("image", "source") & (value != "")).select(F.col("draft_id").cast("long").alias("draft_id"), "kind", value.alias("value")), allowMissingColumns=True)
        if hashes is not None:
            known = hashes.where("high IS NOT NULL AND low IS NOT NULL")
            rows = rows.unionByName(known.select(F.col("draft_id").cast("long").alias("draft_id"), F.lit("hash").alias("kind"), "high", "low"), allowMissingColumns=True)
        rows.where("draft_id IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return self

    def rows(self) -> DataFrame:
        """All exclusions, each once."""
        if not folder_exists(self.spark, self.path):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(f"{_SCHEMA}, batch string").parquet(self.path).drop("batch").distinct()

    def compact(self, path: str, batch: str = "0000") -> Exclusions:
        """The same set as one batch in a new folder; the old one stays as it is, so readers of it are not disturbed."""
        self.rows().write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
        return Exclusions(self.spark, path)

    def of(self, kind: str) -> DataFrame:
        rows = self.rows().where(F.col("kind") == kind)
        return rows.select("draft_id", "high", "low") if kind == "hash" else rows.select("draft_id", "value")

    def allowed(self, candidates: DataFrame) -> DataFrame:
        """Candidates (draft_id, url, page, ...) of which neither the picture's nor the page's address is excluded for their draft."""
        out = candidates
        for kind, column in (("image", "url"), ("source", "page")):
            banned = self.of(kind).select("draft_id", F.col("value").alias(column))
            out = out.join(banned, [(out["draft_id"] == banned["draft_id"]) & (F.trim(out[column]) == banned[column])], "left_anti")
        return out

    def chosen(self, images: DataFrame, most: int = 6) -> DataFrame:
        """Pictures (draft_id, pos, high, low) that resemble neither an excluded one of their draft nor one chosen before them."""
        return without_near_duplicates(images, "draft_id", self.of("hash"), most)
