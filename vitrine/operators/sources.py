"""Sources of product pages: statistics of their attempts, blocking, scores and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.numbers import measured_score, source_score
from vitrine.functions.urls import host
from vitrine.operators.windows import numbered_in_order


def statistics(attempts: DataFrame, key: str = "domain") -> DataFrame:
    """Counters of each source from its attempts (outcome: extracted, accepted or failed; images; kind; at)."""
    is_ = lambda name: F.col("outcome") == name
    return attempts.groupBy(key).agg(
        F.count_if(F.col("outcome").isin("extracted", "failed")).alias("attempt_count"), F.count_if(is_("extracted")).alias("extraction_success_count"), F.count_if(is_("accepted")).alias("accepted_gallery_count"),
        F.sum(F.when(is_("accepted"), F.coalesce("images", F.lit(0))).otherwise(0)).cast("long").alias("accepted_image_count"), F.count_if(is_("failed")).alias("failure_count"),
        F.max_by(F.when(is_("failed"), F.col("kind")), F.when(is_("failed"), F.struct("at", "id"))).alias("last_failure_kind"), F.max("at").alias("last_attempt_at"), F.max(F.when(~is_("failed"), F.col("at"))).alias("last_success_at"),
    )


def dot_suffixes(name: Column) -> Column:
    """A host and all its parent domains of two labels or more."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array(name)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def matching_hosts(left: DataFrame, right: DataFrame, left_host: str, right_host: str) -> DataFrame:
    """Pairs of hosts of which one is the other or a subdomain of it, by two equi-joins on domain suffixes."""
    a = left.select(left_host).where(F.col(left_host) != "").distinct()
    b = right.select(right_host).where(F.col(right_host) != "").distinct()
    down = a.withColumn("__s", F.explode(dot_suffixes(F.col(left_host)))).join(b, F.col("__s") == F.col(right_host)).select(left_host, right_host)
    up = b.withColumn("__s", F.explode(dot_suffixes(F.col(right_host)))).join(a, F.col("__s") == F.col(left_host)).select(left_host, right_host)
    return down.unionByName(up).distinct()


def blocked(pages: DataFrame, recipes: DataFrame, url: str = "url") -> DataFrame:
    """Pages on a blocked domain, or on a sub- or parent domain of one."""
    own = pages.withColumn("__host", host(F.col(url)))
    banned = recipes.where("source_blocked AND domain IS NOT NULL AND domain <> ''").select(host(F.concat(F.lit("https://"), "domain")).alias("__blocked"))
    return own.join(matching_hosts(own, banned, "__host", "__blocked").select("__host").distinct(), "__host", "left_semi").select(*pages.columns)


def unblocked(pages: DataFrame, recipes: DataFrame, url: str = "url") -> DataFrame:
    own = pages.withColumn("__host", host(F.col(url)))
    banned = recipes.where("source_blocked AND domain IS NOT NULL AND domain <> ''").select(host(F.concat(F.lit("https://"), "domain")).alias("__blocked"))
    return own.join(matching_hosts(own, banned, "__host", "__blocked").select("__host").distinct(), "__host", "left_anti").select(*pages.columns)


def scored(candidates: DataFrame, stats: DataFrame, recipes: DataFrame) -> DataFrame:
    """Candidates with ``score``: their domain's measured history, else its recipe's, else 0."""
    measured = stats.select(F.col("domain").alias("__host"), measured_score(*map(F.col, ("attempt_count", "accepted_gallery_count", "accepted_image_count", "extraction_success_count", "failure_count"))).alias("__measured"))
    one = recipes.groupBy(F.col("domain").alias("__host")).agg(F.max_by(F.struct("status", "source_blocked", "success_count", "failure_count"), F.struct("success_count", "failure_count")).alias("__r"))
    joined = candidates.withColumn("__host", host(F.col("url"))).join(measured, "__host", "left").join(one, "__host", "left")
    own = source_score(F.col("__measured"), F.col("__r.status"), F.col("__r.source_blocked"), F.col("__r.success_count"), F.col("__r.failure_count"))
    return joined.withColumn("score", own).select(*candidates.columns, "score")


def ranked(candidates: DataFrame, stats: DataFrame, recipes: DataFrame, *keys: str) -> DataFrame:
    """Candidates without blocked ones, best score first, input order among equals: ``rank`` within ``keys``, or over all without any."""
    rows, order = scored(unblocked(candidates, recipes), stats, recipes), [F.col("score").desc(), F.col("pos")]
    if not keys:
        return numbered_in_order(rows, order)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def primary_first(sources: DataFrame, primary: str, *keys: str) -> DataFrame:
    """The primary page first, all others in their order."""
    w = Window.partitionBy(*keys).orderBy((F.col("url") != F.col(primary)).cast("int"), "pos")
    return sources.withColumn("rank", F.row_number().over(w))


def by_page_or_host(candidates: DataFrame) -> DataFrame:
    """Candidates grouped by the page they were found on, or else by their host."""
    key = F.coalesce(F.concat(F.lit("page:"), F.nullif("page_url", F.lit(""))), F.concat(F.lit("host:"), host(F.col("url"))))
    return candidates.groupBy(key.alias("origin")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def source_line(candidates: DataFrame, *keys: str) -> DataFrame:
    """Distinct hosts of each key in one line, in order of appearance."""
    hosts = candidates.withColumn("__h", host(F.col("url"))).where("__h <> ''").groupBy(*keys, "__h").agg(F.min("pos").alias("__p"))
    return hosts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__h"))), lambda x: x["__h"]), ", ").alias("sources"))


def latest_attempt(attempts: DataFrame, key: str = "telegram_update_id") -> DataFrame:
    """The draft of the latest attempt of each update."""
    return attempts.groupBy(key).agg(F.max_by("product_draft_id", "id").alias("product_draft_id"), F.max("id").alias("id"))
