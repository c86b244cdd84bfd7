"""Token usage and cost: per model, in total, over periods and per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.numbers import cost, count_of, uncached_input


def token_columns(runs: DataFrame, usage: str = "usage") -> DataFrame:
    """Runs with input, cached, output, reasoning and total tokens, from either naming of the usage payload."""
    get = lambda *names: count_of(F.coalesce(*[F.get_json_object(usage, f"$.{n}") for n in names]))
    given, cached, output = get("prompt_tokens", "input_tokens"), get("cache_read_input_tokens", "cached_input_tokens"), get("completion_tokens", "output_tokens")
    fresh = uncached_input(F.col("provider"), given, cached)
    return runs.withColumns({"input": fresh, "cached_input": cached, "output": output, "reasoning": get("reasoning_tokens"), "total": fresh + cached + output})


def by_model(runs: DataFrame, prices: DataFrame, *keys: str) -> DataFrame:
    """Tokens and estimated cost per provider and model (and ``keys``); the cost is null without a price."""
    sums = [F.sum(c).alias(c) for c in ("input", "cached_input", "output", "reasoning", "total")]
    totals = token_columns(runs).groupBy(*keys, "provider", "model").agg(F.count(F.lit(1)).alias("runs"), *sums)
    priced = totals.join(prices.select("provider", "model", "input_per_million", "cached_input_per_million", "output_per_million"), ["provider", "model"], "left")
    own = cost(*map(F.col, ("input", "cached_input", "output", "input_per_million", "cached_input_per_million", "output_per_million")))
    return priced.select(*keys, "provider", "model", "runs", "input", "cached_input", "output", "reasoning", "total", own.alias("cost"))


def in_total(models: DataFrame, *keys: str) -> DataFrame:
    """Grand totals of :func:`by_model`: the cost is the sum of its rounded costs, models without a price left out."""
    sums = [F.sum(c).alias(c) for c in ("runs", "input", "cached_input", "output", "reasoning", "total")]
    money = F.round(F.sum(F.col("cost").cast("decimal(20,6)")), 6).cast("double").alias("cost")
    return models.groupBy(*keys).agg(*sums, money)


def with_periods(runs: DataFrame, now: Column, periods: dict[str, int | None]) -> DataFrame:
    """Each run once for every period it lies in: ``periods`` maps a name to its hours, None for all time."""
    member = [F.when(F.lit(True) if hours is None else F.col("created_at") >= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(name)) for name, hours in periods.items()]
    return runs.withColumn("period", F.explode(F.filter(F.array(*member), lambda p: p.isNotNull())))


def per_update(runs: DataFrame, since: DataFrame) -> DataFrame:
    """Runs and tokens of each update from its ``since`` on, and failed runs whose usage is unknown."""
    own = runs.join(since, "telegram_update_id").where(F.col("created_at") >= F.col("since"))
    tokens = token_columns(own)
    unknown = F.count_if(F.col("usage").isNull() & (F.col("status") == "failed"))
    return tokens.groupBy("telegram_update_id").agg(F.count_if(F.col("usage").isNotNull()).alias("runs"), F.sum("total").alias("total"), unknown.alias("unknown_failures"))


def refreshed_models(models: DataFrame, fetched: DataFrame) -> DataFrame:
    """Price list with availability from the fetched one; new prices count where they are given."""
    f = fetched.select("provider", "model", F.lit(True).alias("__here"), *[F.col(c).alias(f"__{c}") for c in ("input_per_million", "cached_input_per_million", "output_per_million")])
    joined = models.join(f, ["provider", "model"], "left")
    prices = {c: F.coalesce(f"__{c}", c) for c in ("input_per_million", "cached_input_per_million", "output_per_million")}
    return joined.withColumns(prices | {"is_available": F.col("__here").isNotNull()}).select(*models.columns)


def sync_report(models: DataFrame) -> DataFrame:
    return models.agg(F.count_if("is_available").alias("available"), F.count_if(~F.col("is_available")).alias("unavailable"))


def running_cost(steps: DataFrame, key: str, order: str, most: float) -> DataFrame:
    """Steps of each key whose cost so far, without their own, is under the cap."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum("cost").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return steps.withColumn("spent_before", before).where((F.lit(most) <= 0) | (F.col("spent_before") < most))
