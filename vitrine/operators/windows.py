"""Ordered operators: latest rows, renumbering, permutations, streaks, quotas, changes and cooldowns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.numbers import backoff_minutes, is_disabled
from vitrine.session import stored


def latest_per(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The row with the highest ``order`` of each key, by an aggregate that combines before the shuffle."""
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("__r"))
    return packed.select("__r.*")


def last_n(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def role_of(position: Column) -> Column:
    return F.when(position == 0, "primary").when(position <= 2, "secondary").otherwise("detail")


def renumbered(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Dense positions from 0 within a key, with role and primary mark by position."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    out = rows.withColumn("sort_order", position)
    return out.withColumns({"role": role_of(F.col("sort_order")), "is_primary": F.col("sort_order") == 0})


def by_position(rows: DataFrame, keys: list[str], positions: DataFrame, *order: Column) -> DataFrame:
    """Rows at 1-based display positions (keys, position)."""
    placed = rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.join(positions, [*keys, "position"])


def is_permutation(new_order: Column, n: Column) -> Column:
    return F.array_sort(new_order) == F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def permuted(rows: DataFrame, keys: list[str], orders: DataFrame, *order: Column) -> DataFrame:
    """Rows in a new order: ``orders`` has for each key the array of old 1-based positions in new order; invalid ones change nothing."""
    placed = rows.withColumn("__old", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    joined = placed.join(orders, keys, "left")
    valid = F.coalesce(is_permutation(F.col("new_order"), F.col("__n").cast("int")), F.lit(False))
    position = F.when(valid, F.array_position("new_order", F.col("__old"))).otherwise(F.col("__old"))
    return joined.withColumn("sort_order", (position - 1).cast("int")).drop("__old", "__n", "new_order")


def not_last_one(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that may be deleted: their key has others."""
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("__n > 1").drop("__n")


def replaced(old: DataFrame, stored: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """As many old rows of each key as new ones were stored (``stored``: keys, n)."""
    return old.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).join(stored, keys).where("__n <= n").drop("__n", "n")


def within_quota(rows: DataFrame, keys: list[str], order: str, accepted: Column, needed: int, batch: int | None = None, batches: int | None = None) -> DataFrame:
    """Accepted rows until ``needed`` are reached; in batches, whole batches are looked at and at most ``batches`` of them."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = rows.withColumn("__pos", F.row_number().over(w) - 1).withColumn("__ok", accepted.cast("int"))
    if batch:
        out = out.withColumn("__batch", F.floor(F.col("__pos") / batch))
        out = out.where(F.col("__batch") < batches) if batches else out
        before = Window.partitionBy(*keys).orderBy("__batch").rangeBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("__before", F.coalesce(F.sum("__ok").over(before), F.lit(0))).where(F.col("__before") < needed).drop("__batch", "__before")
    running = F.sum("__ok").over(Window.partitionBy(*keys).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("__run", running).where((F.col("__ok") == 1) & (F.col("__run") <= needed)).drop("__pos", "__ok", "__run")


def failure_streaks(events: DataFrame, key: str, order: list[str], kind: str = "kind") -> DataFrame:
    """Each failure with ``failure_count``: how many of its kind in a row since the last success or other kind.

    A success is an event without a kind. Also whether the source is off from here on and, if not,
    the minutes until its next try.
    """
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce((~F.col(kind).eqNullSafe(F.lag(kind).over(w))).cast("int"), F.lit(1))
    islands = events.withColumn("__island", F.sum(F.when(F.row_number().over(w) == 1, 1).otherwise(changed)).over(w))
    own = Window.partitionBy(key, "__island").orderBy(*order)
    counted = islands.where(F.col(kind).isNotNull()).withColumn("failure_count", F.row_number().over(own)).drop("__island")
    off = is_disabled(F.col(kind), F.col("failure_count"))
    return counted.withColumns({"disabled": off, "retry_minutes": F.when(~off, backoff_minutes(F.col(kind), F.col("failure_count")))})


def last_distinct(urls: Column, n: int = 5) -> Column:
    """The last ``n`` distinct entries, in order of first appearance."""
    d = F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))
    return F.when(F.size(d) <= n, d).otherwise(F.slice(d, -n, n))


def deltas(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each state with the one before it and their difference."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("before", before).withColumn("delta", F.col(value) - F.coalesce(F.col("before"), F.lit(0)))


def stable_from(samples: DataFrame, keys: list[str], order: str, value: str, run: int = 3, least: int = 1) -> DataFrame:
    """The first sample of each key that ends ``run`` equal ones in a row of at least ``least`` items."""
    w = Window.partitionBy(*keys).orderBy(order)
    islands = samples.withColumn("__i", F.sum(F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))).over(w))
    counted = islands.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__i").orderBy(order)))
    good = counted.where((F.col("__r") >= run) & (F.col(value) >= least))
    return good.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__i", "__r", "__n")


def changes(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__p", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__p"))).drop("__p", "__n")


def numbered_in_order(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their number 1, 2, 3... in ``order`` over the whole table, by a range sort over all tasks.

    The sorted rows are written once, each with its place in its partition; a partition's first number is the count of rows in those
    before it, one small row each. Rows equal in ``order`` are numbered in a fixed but arbitrary order, and meet in one partition.
    """
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "in_order")
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("__part")).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))  # a row for each partition
    joined = placed.withColumn("__part", part).join(F.broadcast(counts), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).select(*rows.columns, name)


#: Cells of one block: what a window runs over at most when it looks for the next cell that holds anything.
CELLS = 1024


def running_total(rows: DataFrame, key: str, at: str, value: Column, name: str, cell: Column) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with their ``at`` as column ``name``.

    ``cell`` numbers stretches of ``at`` in its order. Sums run within the cells of a key, and then over the cells' totals, so a
    key with very many rows does not meet in one task.
    """
    celled = rows.withColumn("__cell", cell)
    totals = celled.groupBy(key, "__cell").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(key).alias("__k"), F.col("__cell").alias("__c"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy(key, "__cell").orderBy(at))
    joined = celled.withColumn(name, inside).join(offsets, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__cell") == F.col("__c")))
    return joined.withColumn(name, F.col(name) + F.col("__before")).select(*rows.columns, name)


def cooldown_pointers(times: DataFrame, cooldown: float) -> DataFrame:
    """(k, t, n): for each distinct time t of a key the first one n at or after t + ``cooldown``, where there is one.

    Times lie in cells as long as the cooldown. The next one is looked for in the cell of t + cooldown, then among the cells after
    it, block by block; no window runs over a whole key's times.
    """
    probe = F.col("t") + cooldown
    cell = lambda c: F.floor(c / cooldown)
    events = times.select("k", cell(F.col("t")).alias("c"), "t", F.lit(None).cast("double").alias("asks"))
    probes = times.select("k", cell(probe).alias("c"), probe.alias("t"), F.col("t").alias("asks"))
    both = events.unionAll(probes)
    is_event = F.col("asks").isNull()
    onwards = Window.partitionBy("k", "c").orderBy("t", is_event.cast("int")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    here = both.withColumn("here", F.min(F.when(is_event, F.col("t"))).over(onwards)).where(~is_event).select("k", "c", F.col("asks").alias("t"), "here")
    cells = both.groupBy("k", "c").agg(F.min(F.when(is_event, F.col("t"))).alias("first")).withColumn("block", F.floor(F.col("c") / CELLS))
    after = lambda *keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    later = cells.groupBy("k", "block").agg(F.min("first").alias("first")).withColumn("later", F.min("first").over(after("k", order="block"))).select("k", "block", "later")
    following = cells.withColumn("soon", F.min("first").over(after("k", "block", order="c"))).join(later, ["k", "block"]).select("k", "c", F.coalesce("soon", "later").alias("follows"))
    return here.join(following, ["k", "c"]).select("k", "t", F.coalesce("here", "follows").alias("n")).where("n IS NOT NULL")


#: Distinct times of a key that are stepped through in one array; keys with more are spread over tasks.
IN_ARRAY = 10_000


def with_cooldown(events: DataFrame, key: str, seconds: str, cooldown: float) -> DataFrame:
    """(key, seconds): the distinct times of each key that are let through: the first, then the first at or after ``cooldown`` seconds from the last let through.

    Which time passes depends on those before it. A key with up to ``IN_ARRAY`` distinct times is stepped through in an array, by a
    binary search from one that passes to the next. The times of larger keys go through :func:`marked_by_doubling`. A null key is a key of its
    own; null times never pass.
    """
    named = F.struct(F.col(key).alias("key"))
    times = stored(events.where(F.col(seconds).isNotNull()).select(named.alias("k"), F.col(seconds).cast("double").alias("t")).distinct(), "times")
    out = lambda rows: rows.select(F.col("k.key").alias(key), F.col("t").alias("seconds"))
    if cooldown <= 0:
        return out(times)
    large = stored(times.groupBy("k").count().where(F.col("count") > IN_ARRAY).select("k"), "large")
    if large.isEmpty():
        return out(_stepped(times, cooldown))
    small, spread = times.join(large, "k", "left_anti"), stored(times.join(large, "k", "left_semi"), "spread")
    return out(_stepped(small, cooldown).unionByName(marked_by_doubling(spread, cooldown)))


def _stepped(times: DataFrame, cooldown: float) -> DataFrame:
    @F.pandas_udf("array<double>")
    def passing(arrays: pd.Series) -> pd.Series:
        def step(t: np.ndarray) -> list[float]:
            out, at = [], 0
            while at < len(t):
                out.append(float(t[at]))
                at = max(at + 1, int(np.searchsorted(t, t[at] + cooldown)))
            return out

        return arrays.map(step)

    return times.groupBy("k").agg(F.array_sort(F.collect_list("t")).alias("t")).select("k", F.explode(passing("t")).alias("t"))


def marked_by_doubling(times: DataFrame, cooldown: float) -> DataFrame:
    """(k, t): the times that pass, of distinct ones.

    Every time points to the one that would pass next, and the pointers are doubled: after step i each reaches 2^i further, and the times
    reached from the first one of a key are marked. The steps are joins on (k, t), so one key spreads over all tasks; their number is
    the logarithm of the longest chain.
    """
    reached = times.groupBy("k").agg(F.min("t").alias("t"))
    pointers = stored(cooldown_pointers(times, cooldown), "pointers")
    while not pointers.isEmpty():
        step = pointers.select("k", F.col("t").alias("at"), "n")
        jumped = reached.join(step.withColumnRenamed("at", "t"), ["k", "t"]).select("k", F.col("n").alias("t"))
        reached = stored(reached.unionByName(jumped), "reached")
        further = step.withColumnRenamed("n", "t").join(pointers, ["k", "t"]).select("k", F.col("at").alias("t"), "n")
        pointers = stored(further, "pointers")
    return reached


def queue_alerts(checks: DataFrame, key: str, threshold: int = 180, cooldown: int = 900) -> DataFrame:
    """Alerts of health checks (key, at seconds, oldest_waiting seconds or null): waiting over the threshold, once a cooldown; draining the queue ends the cooldown."""
    drained = F.col("oldest_waiting").isNull().cast("long")
    stuck = running_total(checks, key, "at", drained, "spell", F.floor(F.col("at") / (CELLS * cooldown))).where(F.col("oldest_waiting").isNotNull() & (F.col("at") - F.col("oldest_waiting") >= threshold))
    passed = with_cooldown(stuck.select(F.struct(key, "spell").alias("k"), "at"), "k", "at", cooldown)
    return passed.select(f"k.{key}", F.col("seconds").cast("long").alias("at"))


def oldest_waiting(jobs: DataFrame, now: Column) -> DataFrame:
    """Per queue: the oldest unreserved job and its age in whole minutes."""
    w = jobs.where("reserved_at IS NULL").groupBy("queue").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.min("created_at").alias("created_at"))
    return w.withColumn("minutes", F.floor((now - F.col("created_at")) / 60).cast("long"))
