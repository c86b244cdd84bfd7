"""References that are not plain keys: (type, id) pairs, redirects, pages that pictures came from, and counts beside a result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vitrine.functions.urls import absolute, is_public
from vitrine.session import stored
from vitrine.streaming.intake import available_now


def resolved(rows: DataFrame, targets: dict[str, DataFrame], type_: str = "target_type", id_: str = "target_id") -> DataFrame:
    """``rows`` with ``target``, the struct of the row that (type, id) refers to, as JSON; null where it refers to none.

    ``targets`` has a table for each type, with its key in ``id``. Only tables of types that occur are read, each once, by a join of the
    rows of that type alone; rows of other types pass through.
    """
    present = {r[0] for r in rows.where(F.col(type_).isin(list(targets))).select(type_).distinct().collect()}  # at most one for each table
    parts = [rows.where(~F.coalesce(F.col(type_).isin(sorted(present)), F.lit(False))).withColumn("target", F.lit(None).cast("string"))]
    for name in sorted(present):
        table = targets[name]
        target = table.select(F.col("id").alias("__id"), F.to_json(F.struct(*table.columns)).alias("target"))
        own = rows.where(F.col(type_) == name)
        parts.append(own.join(target, own[id_] == target["__id"], "left").drop("__id"))
    return reduce(DataFrame.unionByName, parts)


def redirected(requests: DataFrame, responses: DataFrame, most: int = 3) -> DataFrame:
    """``requests`` (url, ...) with ``final_url``, ``hops`` and ``refused``: where each ends after at most ``most`` redirects.

    ``responses`` has (url, status, location) of each address once. Every address on the way is checked before it is asked: one that
    is not public ends the walk as ``blocked``. A redirect without a location is ``no_location``, an address without a
    response ``missing``, an error of the server ``failed``, and one redirect too many, as in a loop, ``too_many``. The walk is ``most`` + 1 joins, whatever the chains.
    """
    known = responses.select(F.col("url").alias("__url"), F.col("status").alias("__status"), F.col("location").alias("__location"))
    walk = requests.withColumns({"final_url": F.col("url"), "hops": F.lit(0), "refused": F.lit(None).cast("string"), "__open": F.lit(True)})
    for hop in range(most + 1):
        asked = walk.join(known, F.col("__open") & (F.col("final_url") == F.col("__url")), "left")
        redirect = F.col("__status").between(300, 399)
        verdict = F.when(~is_public(F.col("final_url")), "blocked").when(F.col("__status").isNull(), "missing").when(redirect & (F.coalesce("__location", F.lit("")) == ""), "no_location").when(F.col("__status") >= 400, "failed")
        if hop == most:
            verdict = F.coalesce(verdict, F.when(redirect, "too_many"))
        goes_on = F.col("__open") & verdict.isNull() & F.coalesce(redirect, F.lit(False))
        walk = asked.withColumns({
            "refused": F.when(F.col("__open"), verdict).otherwise(F.col("refused")), "final_url": F.when(goes_on, absolute(F.col("__location"), F.col("final_url"))).otherwise(F.col("final_url")),
            "hops": F.col("hops") + goes_on.cast("int"), "__open": goes_on}).drop("__url", "__status", "__location")
    return walk.drop("__open")


def pages_of_picks(found: DataFrame, picks: DataFrame, memory: str = "7 days", delay: str = "1 day", name: str = "picks") -> DataFrame:
    """(pick_id, url, picked_at, page, found_at): the page on which a picked picture was last found before it was picked.

    ``found`` (url, page, found_at) and ``picks`` (pick_id, url, picked_at) are streams with watermarks of ``delay``; they are joined by
    address within ``memory``, so the state of either side ends. The last writer wins: of several pages the one found last, at equal times the greatest. Picks of pictures that
    were not found have no row.
    """
    pages = found.select("url", "page", "found_at").withWatermark("found_at", delay)
    picked = picks.select(F.col("pick_id"), F.col("url").alias("__url"), "picked_at").withWatermark("picked_at", delay)
    within = (F.col("url") == F.col("__url")) & (F.col("found_at") <= F.col("picked_at")) & (F.col("found_at") > F.col("picked_at") - F.expr(f"INTERVAL {memory}"))
    matched = available_now(pages.join(picked, within).select("pick_id", "url", "picked_at", "page", "found_at"), name, "append")
    return matched.groupBy("pick_id", "url", "picked_at").agg(F.max(F.struct("found_at", "page")).alias("last")).select("pick_id", "url", "picked_at", "last.page", "last.found_at")


def with_diagnostics(rows: DataFrame, name: str = "diagnostics", **counts: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, diagnostics): the rows, and one row of aggregates ``counts`` over them, from the same pass.

    The counts are observed while the rows are written to the shared folder, so nothing is scanned twice.
    """
    seen = Observation(name)
    kept = stored(rows.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    values = seen.get
    return kept, rows.sparkSession.range(1).select(*[F.lit(values[k]).alias(k) for k in counts])
