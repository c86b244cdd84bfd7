"""Usage, sources, ranking, windows, state: queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import dates as D
from vitrine.functions import numbers as N
from vitrine.functions import payloads as P
from vitrine.functions import urls as U
from vitrine.operators import retries as R
from vitrine.operators import sources as S
from vitrine.operators import usage as A
from vitrine.operators import windows as W
from vitrine.plans.binding import bound, with_bound
from vitrine.registry import query
from vitrine.session import table

_TOKENS = """
    , tokens AS (SELECT *, CASE WHEN provider = 'openai' THEN given ELSE greatest(0, given - cached_input) END AS input FROM (
        SELECT *, coalesce(CAST(json_extract_string(usage, '$.prompt_tokens') AS BIGINT), 0) AS given, coalesce(CAST(json_extract_string(usage, '$.cache_read_input_tokens') AS BIGINT), 0) AS cached_input,
               coalesce(CAST(json_extract_string(usage, '$.output_tokens') AS BIGINT), 0) AS output FROM ai_runs)),
    """


def _models(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""models AS (SELECT {k}t.provider, t.model, count(*) AS runs, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cached_input) AS BIGINT) AS cached_input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(input + cached_input + output) AS BIGINT) AS total,
        round(CAST(sum(input) * max(m.input_per_million) + sum(cached_input) * max(m.cached_input_per_million) + sum(output) * max(m.output_per_million) AS DECIMAL(30,6)) / 1000000, 6) AS cost
      FROM tokens t LEFT JOIN ai_models m ON m.provider = t.provider AND m.model = t.model GROUP BY {k}t.provider, t.model)"""


@query("usage_by_model", with_bound(_TOKENS + _models() + " SELECT * FROM models", "ai_runs", "ai_models"))
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_model(bound(spark, sf_dir, "ai_runs"), bound(spark, sf_dir, "ai_models")).drop("reasoning")


@query("usage_total", with_bound(_TOKENS + _models() + " SELECT CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(total) AS BIGINT) AS total, round(sum(cost), 6) AS cost FROM models", "ai_runs", "ai_models"))
def usage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.in_total(A.by_model(bound(spark, sf_dir, "ai_runs"), bound(spark, sf_dir, "ai_models"))).select("runs", "total", "cost")


_PERIODS = {"day": 24, "week": 168, "month": 720, "all": None}


@query("usage_periods", with_bound(_TOKENS.replace("FROM ai_runs)", "FROM ai_runs JOIN (SELECT 'day' AS period, 24 AS h UNION ALL SELECT 'week', 168 UNION ALL SELECT 'month', 720 UNION ALL SELECT 'all', 1000000) ON created_at >= (SELECT max(created_at) FROM ai_runs) - to_hours(h))") + _models("period") + " SELECT * FROM models", "ai_runs", "ai_models"))
def usage_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = bound(spark, sf_dir, "ai_runs")
    now = F.lit(runs.agg(F.max("created_at")).first()[0]).cast("timestamp_ntz")
    return A.by_model(A.with_periods(runs, now, _PERIODS), bound(spark, sf_dir, "ai_models"), "period").drop("reasoning")


@query("usage_per_update_since", with_bound(_TOKENS + """s AS (SELECT telegram_update_id, min(created_at) + INTERVAL 3 DAY AS since FROM ai_runs GROUP BY 1)
    SELECT t.telegram_update_id, count(usage) AS runs, CAST(sum(input + cached_input + output) AS BIGINT) AS total, count(*) FILTER (WHERE usage IS NULL AND status = 'failed') AS unknown_failures FROM tokens t JOIN s USING (telegram_update_id) WHERE created_at >= since GROUP BY 1""", "ai_runs"))
def usage_per_update_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = bound(spark, sf_dir, "ai_runs")
    since = runs.groupBy("telegram_update_id").agg((F.min("created_at") + F.expr("INTERVAL 3 DAY")).alias("since"))
    return A.per_update(runs, since)


@query("usage_null_aware_sum", with_bound(_TOKENS + _models() + " SELECT provider, sum(cost) AS cost, count(*) FILTER (WHERE cost IS NULL) AS unknown FROM models GROUP BY provider", "ai_runs", "ai_models"))
def usage_null_aware_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = A.by_model(bound(spark, sf_dir, "ai_runs"), bound(spark, sf_dir, "ai_models"))
    return models.groupBy("provider").agg(F.sum(F.col("cost").cast("decimal(20,6)")).cast("double").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unknown"))


@query("model_refresh", with_bound("SELECT m.provider, m.model, CAST(CASE WHEN m.model = 'click' THEN 0.75 ELSE input_per_million END AS DOUBLE) AS input_price, m.provider = 'openai' AS is_available FROM ai_models m", "ai_models"))
def model_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = bound(spark, sf_dir, "ai_models").withColumn("is_available", F.lit(True))
    fetched = bound(spark, sf_dir, "ai_models").where("provider = 'openai'").withColumn("input_per_million", F.when(F.col("model") == "click", F.lit("0.75").cast("decimal(12,6)")))
    return A.refreshed_models(models, fetched).select("provider", "model", F.col("input_per_million").cast("double").alias("input_price"), "is_available")


@query("cost_bounded_steps", "SELECT event_id FROM (SELECT event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT *, floor(value) AS v FROM events)) WHERE b < 300".replace("sum(value)", "sum(v)"))
def cost_bounded_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.running_cost(table(spark, sf_dir, "events").withColumn("cost", F.floor("value").cast("double")), "user_id", "event_id", 300.0).select("event_id")


# ---- sources -----------------------------------------------------------------------------------

_STATS = """stats AS (SELECT domain, count(*) FILTER (WHERE outcome IN ('extracted', 'failed')) AS attempt_count, count(*) FILTER (WHERE outcome = 'extracted') AS extraction_success_count, count(*) FILTER (WHERE outcome = 'accepted') AS accepted_gallery_count,
      CAST(coalesce(sum(images) FILTER (WHERE outcome = 'accepted'), 0) AS BIGINT) AS accepted_image_count, count(*) FILTER (WHERE outcome = 'failed') AS failure_count, arg_max(kind, ("at", id)) FILTER (WHERE outcome = 'failed') AS last_failure_kind,
      max("at") AS last_attempt_at, max("at") FILTER (WHERE outcome <> 'failed') AS last_success_at FROM attempts GROUP BY domain)"""
_SCORE = """CAST(CASE WHEN attempt_count <= 0 THEN 0 WHEN accepted_gallery_count > 0 THEN 100000 + round((accepted_gallery_count + 1) / (attempt_count + 2) * 10000) + least(1000, accepted_image_count)
      WHEN extraction_success_count > 0 THEN 50000 + round((extraction_success_count + 1) / (attempt_count + 2) * 5000) + least(500, extraction_success_count) ELSE -least(10000, greatest(1, failure_count)) END AS BIGINT)"""


@query("source_stats", with_bound(", " + _STATS + " SELECT * FROM stats", "attempts"))
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.statistics(bound(spark, sf_dir, "attempts"))


@query("source_score", with_bound(", " + _STATS + f" SELECT domain, {_SCORE} AS score FROM stats", "attempts"))
def source_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = S.statistics(bound(spark, sf_dir, "attempts"))
    return stats.select("domain", N.measured_score(*map(F.col, ("attempt_count", "accepted_gallery_count", "accepted_image_count", "extraction_success_count", "failure_count"))).alias("score"))


_RECIPES = "recipes AS (SELECT DISTINCT concat('s', CAST(user_id AS VARCHAR(20)), '.shop.example') AS domain, CASE WHEN user_id % 5 = 0 THEN 'disabled' WHEN user_id % 5 = 1 THEN 'active' ELSE 'learning' END AS status, user_id % 11 = 0 AS source_blocked, user_id % 4 AS success_count, user_id % 3 AS failure_count FROM events WHERE user_id % 2 = 0)"
_CANDIDATES = "candidates AS (SELECT CAST(c_custkey AS BIGINT) AS pos, concat('https://www.s', CAST(c_custkey % 220 AS VARCHAR(20)), '.shop.example/p/', CAST(c_custkey AS VARCHAR(20))) AS url, c_nationkey AS draft FROM customer)"


def _recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH " + _RECIPES.replace("FROM events", "FROM {events}") + " SELECT * FROM recipes", events=table(spark, sf_dir, "events"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH " + _CANDIDATES.replace("FROM customer", "FROM {customer}") + " SELECT * FROM candidates", customer=table(spark, sf_dir, "customer"))


_RANKED = with_bound(f""", {_STATS}, {_RECIPES}, {_CANDIDATES},
    one AS (SELECT c.*, regexp_extract(url, 'https://www\\.([^/]+)', 1) AS host FROM candidates c),
    scored AS (SELECT o.*, CASE WHEN r.source_blocked OR r.status = 'disabled' THEN -1000000 WHEN coalesce(s.score, 0) <> 0 THEN s.score WHEN r.status = 'active' AND r.success_count > 0 THEN CAST(50000 + round((r.success_count + 1) / (r.success_count + r.failure_count + 2) * 5000) + least(500, r.success_count) AS BIGINT)
        WHEN r.failure_count > 0 THEN -least(10000, r.failure_count) ELSE 0 END AS score, coalesce(r.source_blocked, false) AS blocked
      FROM one o LEFT JOIN (SELECT domain, {_SCORE} AS score FROM stats) s ON s.domain = o.host LEFT JOIN recipes r ON r.domain = o.host)
    """, "attempts")


@query("source_rank", _RANKED + "SELECT draft, pos, score, row_number() OVER (PARTITION BY draft ORDER BY score DESC, pos) AS rank FROM scored WHERE NOT blocked")
def source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = S.statistics(bound(spark, sf_dir, "attempts"))
    return S.ranked(_candidates(spark, sf_dir), stats, _recipes(spark, sf_dir), "draft").select("draft", "pos", "score", "rank")


@query("source_rank_overall", _RANKED + "SELECT pos, score, row_number() OVER (ORDER BY score DESC, pos) AS rank FROM scored WHERE NOT blocked")
def source_rank_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all drafts in one order."""
    return S.ranked(_candidates(spark, sf_dir), S.statistics(bound(spark, sf_dir, "attempts")), _recipes(spark, sf_dir)).select("pos", "score", "rank")


@query("source_primary_first", f"WITH {_CANDIDATES} SELECT draft, pos, row_number() OVER (PARTITION BY draft ORDER BY CASE WHEN url LIKE '%00' THEN 0 ELSE 1 END, pos) AS rank FROM candidates".replace("CASE WHEN url LIKE '%00' THEN 0 ELSE 1 END", "CASE WHEN url = (SELECT max(url) FROM candidates) THEN 0 ELSE 1 END"))
def source_primary_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    top = c.agg(F.max("url").alias("primary"))
    return S.primary_first(c.join(top), "primary", "draft").select("draft", "pos", "rank")  # top is one row


@query("candidates_by_origin", f"WITH {_CANDIDATES}, k AS (SELECT pos, CASE WHEN pos % 3 = 0 THEN 'page:' || url ELSE 'host:' || regexp_extract(url, 'https://www\\.([^/]+)', 1) END AS origin FROM candidates) SELECT origin, count(*) AS n, min(pos) AS first_pos FROM k GROUP BY origin")
def candidates_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_page_or_host(_candidates(spark, sf_dir).withColumn("page_url", F.when(F.col("pos") % 3 == 0, F.col("url"))))


@query("source_line", f"WITH {_CANDIDATES}, h AS (SELECT draft, regexp_extract(url, 'https://www\\.([^/]+)', 1) AS host, min(pos) AS p FROM candidates GROUP BY ALL) SELECT draft, string_agg(host, ', ' ORDER BY p) AS sources FROM h GROUP BY draft")
def source_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.source_line(_candidates(spark, sf_dir), "draft")


@query("latest_attempt", with_bound("SELECT domain, arg_max(images, id) AS product_draft_id, max(id) AS id FROM attempts GROUP BY domain", "attempts"))
def latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_attempt(bound(spark, sf_dir, "attempts").withColumnRenamed("images", "product_draft_id"), "domain")


@query("url_blocked_suffix", """
    WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^.*?www\\.', '') AS host FROM pages), b AS (SELECT DISTINCT host AS blocked FROM h WHERE page_id % 7 = 0)
    SELECT page_id FROM h WHERE EXISTS (SELECT 1 FROM b WHERE host = blocked OR ends_with(host, '.' || blocked) OR ends_with(blocked, '.' || host))""")
def url_blocked_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    recipes = pages.where("page_id % 7 = 0").select(U.raw_host(F.col("url")).alias("domain"), F.lit(True).alias("source_blocked"))
    return S.blocked(pages, recipes).select("page_id")


# ---- windows -----------------------------------------------------------------------------------


@query("failure_streaks", with_bound("""
    , c AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS changed FROM failures WINDOW w AS (PARTITION BY domain ORDER BY "at", id)),
    i AS (SELECT *, sum(changed) OVER (PARTITION BY domain ORDER BY "at", id) AS island FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY domain, island ORDER BY "at", id) AS failure_count FROM i WHERE kind IS NOT NULL)
    SELECT id, domain, failure_count, coalesce(failure_count >= CASE kind WHEN 'recipe_mismatch' THEN 2 WHEN 'browser_timeout' THEN 3 END, false) AS disabled,
           CASE WHEN failure_count >= CASE kind WHEN 'recipe_mismatch' THEN 2 WHEN 'browser_timeout' THEN 3 ELSE 1000000 END THEN NULL WHEN kind = 'browser_timeout' THEN CAST(least(60, pow(2, least(5, failure_count))) AS INT) WHEN kind = 'rate_limited' THEN 30 ELSE 10 END AS retry_minutes FROM n""", "failures"))
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.failure_streaks(bound(spark, sf_dir, "failures"), "domain", ["at", "id"]).select("id", "domain", "failure_count", "disabled", "retry_minutes")


_CHECKS = "checks AS (SELECT concat('q', CAST(user_id % 20 AS VARCHAR(20))) AS queue, CAST(floor(epoch(ts)) AS BIGINT) AS at, CAST(CASE WHEN min(event_type) = 'purchase' THEN NULL ELSE floor(epoch(ts)) - (min(user_id) % 10) * 60 END AS BIGINT) AS oldest_waiting FROM events GROUP BY 1, 2, ts)"


@query("queue_alerts", f"""
    WITH RECURSIVE {_CHECKS}, one AS (SELECT queue, "at" AS t, max(oldest_waiting) AS oldest_waiting FROM checks GROUP BY ALL), spelled AS (SELECT *, sum(CASE WHEN oldest_waiting IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY t) AS spell FROM one),
    stuck AS (SELECT queue, spell, t FROM spelled WHERE t - oldest_waiting >= 180),
    alerts AS (SELECT queue, spell, min(t) AS t FROM stuck GROUP BY queue, spell UNION ALL SELECT a.queue, a.spell, (SELECT min(s.t) FROM stuck s WHERE s.queue = a.queue AND s.spell = a.spell AND s.t - a.t >= 900) FROM alerts a WHERE a.t IS NOT NULL)
    SELECT queue, t AS "at" FROM alerts WHERE t IS NOT NULL""")
def queue_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.queue_alerts(_checks(spark, sf_dir), "queue").select("queue", "at")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    rows = events.groupBy(F.concat(F.lit("q"), (F.col("user_id") % 20).cast("string")).alias("queue"), "at", "ts").agg(F.min("event_type").alias("e"), F.min("user_id").alias("u"))
    waiting = F.when(F.col("e") != "purchase", F.col("at") - (F.col("u") % 10) * 60)
    return rows.withColumn("oldest_waiting", waiting).groupBy("queue", "at").agg(F.max("oldest_waiting").alias("oldest_waiting"))


@query("oldest_waiting", "SELECT o_orderpriority AS queue, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS id, min(epoch(o_orderdate))::BIGINT AS created_at, ((1000000000 - min(epoch(o_orderdate))::BIGINT) // 60) AS minutes FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def oldest_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("queue"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.when(F.col("o_orderstatus") != "O", 1).alias("reserved_at"))
    return W.oldest_waiting(jobs, F.lit(1_000_000_000))


@query("renumber_positions", with_bound("SELECT product_id, id, n AS sort_order, CASE WHEN n = 0 THEN 'primary' WHEN n <= 2 THEN 'secondary' ELSE 'detail' END AS role, n = 0 AS is_primary FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY is_primary DESC, sort_order, id) - 1 AS INT) AS n FROM media)".replace("n AS sort_order", "n AS sort_order"), "media"))
def renumber_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.renumbered(bound(spark, sf_dir, "media"), ["product_id"], F.col("is_primary").desc(), F.col("sort_order"), F.col("id")).select("product_id", "id", "sort_order", "role", "is_primary")


@query("permute_positions", with_bound("SELECT product_id, id, CAST(CASE WHEN product_id % 2 = 0 THEN c - n ELSE n - 1 END AS INT) AS sort_order FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY id) AS n, count(*) OVER (PARTITION BY product_id) AS c FROM media)", "media"))
def permute_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even products are reversed; odd ones get an invalid order, which changes nothing."""
    media = bound(spark, sf_dir, "media")
    n = media.groupBy("product_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    orders = n.select("product_id", F.when(F.col("product_id") % 2 == 0, F.reverse(F.sequence(F.lit(1), F.col("n")))).otherwise(F.array(F.lit(7), F.lit(7))).alias("new_order"))
    return W.permuted(media, ["product_id"], orders, F.col("id")).select("product_id", "id", "sort_order")


@query("display_positions", with_bound("SELECT product_id, position, id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY product_id ORDER BY sort_order, id) AS INT) AS position FROM media) WHERE position IN (2, 5)", "media"))
def display_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = bound(spark, sf_dir, "media")
    wanted = media.select("product_id").distinct().select("product_id", F.explode(F.array(F.lit(2), F.lit(5))).alias("position"))
    return W.by_position(media, ["product_id"], wanted, F.col("sort_order"), F.col("id")).select("product_id", "position", "id")


@query("not_last_photo", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def not_last_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.not_last_one(table(spark, sf_dir, "orders"), ["o_custkey"]).select("o_orderkey")


@query("replace_stored", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) JOIN customer ON c_custkey = o_custkey WHERE n <= c_nationkey % 4")
def replace_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 4).alias("n"))
    return W.replaced(table(spark, sf_dir, "orders"), stored, ["o_custkey"], F.col("o_orderkey")).select("o_orderkey")


@query("quota_selection", """
    WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS hit FROM events), q AS (SELECT *, pos // 4 AS batch FROM p), b AS (SELECT * FROM q WHERE batch < 5),
    t AS (SELECT user_id, batch, sum(hit) AS k FROM b GROUP BY user_id, batch), u AS (SELECT user_id, batch, sum(k) OVER (PARTITION BY user_id ORDER BY batch) - k AS earlier FROM t), j AS (SELECT b.* FROM b JOIN u ON u.user_id = b.user_id AND u.batch = b.batch WHERE earlier < 3),
    r AS (SELECT event_id, hit, sum(hit) OVER (PARTITION BY user_id ORDER BY pos) AS running FROM j)
    SELECT event_id FROM r WHERE hit = 1 AND running <= 3""")
def quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.within_quota(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "view", 3, 4, 5).select("event_id")


@query("state_deltas", "SELECT event_id, lag(v) OVER w AS before, v - coalesce(lag(v) OVER w, 0) AS delta FROM (SELECT *, event_id % 9 AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def state_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.deltas(table(spark, sf_dir, "events").withColumn("v", F.col("event_id") % 9), ["user_id"], "event_id", "v").select("event_id", "before", "delta")


@query("stable_samples", """
    WITH i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS ch FROM (SELECT *, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS v FROM events))),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS run FROM i) SELECT user_id, min(event_id) AS event_id FROM r WHERE run >= 3 AND v >= 2 GROUP BY user_id""")
def stable_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "view", 2).otherwise(1))
    return W.stable_from(rows, ["user_id"], "event_id", "v", 3, 2).select("user_id", "event_id")


@query("value_changes", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1 OR event_type <> p")
def value_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.changes(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("event_id")


@query("last_hard_blocks", "SELECT user_id, list_sort(list_slice(l, greatest(1, len(l) - 4), len(l))) AS urls FROM (SELECT user_id, list(k ORDER BY f) AS l FROM (SELECT user_id, event_id % 13 AS k, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id)".replace("AS urls", "AS urls"))
def last_hard_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 13).alias("k")))), lambda x: x["k"].cast("string")).alias("l"))
    return lists.select("user_id", F.array_sort(F.transform(W.last_distinct(F.col("l")), lambda x: x.cast("long"))).alias("urls"))


@query("retry_schedule", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + CASE WHEN user_id % 3 <= 1 THEN 30 ELSE 180 END AS scheduled_at FROM events WHERE user_id % 3 < 2 AND event_type = 'error'")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("attempts"), F.when(F.col("event_type") == "error", "Connection reset").otherwise("Invalid model").alias("message"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("failed_at"))
    return R.scheduled(rows).select("event_id", "scheduled_at")


@query("chunk_remainder", "SELECT event_id FROM (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS chunk FROM events) WHERE chunk % 2 = 1")
def chunk_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = R.chunked(table(spark, sf_dir, "events").withColumn("owner", F.col("user_id")), "event_id", 10)
    done = chunks.where("chunk % 2 = 0").select("owner", "chunk").distinct()
    return R.remainder(chunks, done).select("event_id")


@query("result_cache", with_bound("SELECT a.id, (SELECT max(b.id) FROM ai_runs b WHERE b.status = 'completed' AND b.telegram_update_id = a.telegram_update_id AND b.provider = a.provider AND b.model = a.model AND b.prompt = a.prompt) AS cached_result FROM ai_runs a", "ai_runs"))
def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = bound(spark, sf_dir, "ai_runs")
    return R.cached(runs, runs.withColumn("result", F.col("id"))).select("id", "cached_result")


# ---- numbers and dates -------------------------------------------------------------------------


@query("number_rules", """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(greatest(1, least(10, l_quantity)) AS INT) AS clamped, (200.0 - l_quantity) >= 160 AS can_start, least(w, h) >= 450 AND w / greatest(h, 1) BETWEEN 0.28 AND 3.5 AS useful, w * h <= 1500000 AS decodable,
      greatest(1, CAST(round(w * least(1.0, least(1600.0 / w, 1600.0 / h))) AS INT)) AS fit_w, least(100, l_linenumber * 10 + least(20, l_suppkey)) AS recipe_score, round(0.299 * w + 0.587 * h + 0.114 * l_tax, 6) AS luma
    FROM (SELECT *, CAST(l_quantity * 61 AS BIGINT) AS w, CAST(l_discount * 20000 + 1 AS BIGINT) AS h FROM lineitem)""")
def number_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("w", F.expr("CAST(l_quantity * 61 AS BIGINT)")).withColumn("h", F.round(F.col("l_discount") * 20000 + 1).cast("long"))
    w, h = F.col("w"), F.col("h")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", N.clamp(F.col("l_quantity"), 1.0, 10.0).cast("int").alias("clamped"), N.can_start(200 - F.col("l_quantity"), 160).alias("can_start"), N.useful_dimensions(w, h).alias("useful"),
        N.safe_to_decode(w, h, 1_500_000).alias("decodable"), N.fitted(w, h)["width"].alias("fit_w"), N.recipe_score(F.col("l_linenumber"), F.col("l_suppkey")).alias("recipe_score"), F.round(N.luminance(w, h, F.col("l_tax")), 6).alias("luma"))


@query("time_budget", "SELECT event_id, greatest(0, 1080 - e) AS remaining, CASE WHEN 1080 - e >= 181 THEN true ELSE false END AS can_start, CAST(least(360, greatest(1, greatest(0, 1080 - e))) AS BIGINT) AS timeout FROM (SELECT event_id, event_id % 1300 AS e FROM events)")
def time_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    left = N.remaining_seconds(start, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") % 1300))
    return table(spark, sf_dir, "events").select("event_id", left.alias("remaining"), N.can_start(left, 181).alias("can_start"), N.timeout_for(left, 360).cast("long").alias("timeout"))


@query("gallery_verdicts", """SELECT event_id, passed, expected, CASE WHEN NOT g THEN 'no_gallery' WHEN expected < 2 THEN 'too_few_expected' WHEN e < expected THEN 'incomplete' ELSE 'complete' END AS reason, CASE WHEN g AND expected >= 2 AND o >= expected THEN 400 ELSE 600 END AS side
    FROM (SELECT *, g AND expected >= 2 AND e >= expected AS passed FROM (SELECT event_id, event_type <> 'error' AS g, least(10, greatest(event_id % 5, user_id % 13)) AS expected, event_id % 11 AS e, user_id % 13 AS o FROM events))""")
def gallery_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    v = N.gallery_verdict(F.col("event_type") != "error", e % 5, u % 13, e % 11, 10)
    side = N.probe_minimum_side(F.lit(600), F.lit(400), F.col("event_type") != "error", v["expected"], u % 13)
    return table(spark, sf_dir, "events").select("event_id", v["passed"].alias("passed"), v["expected"].alias("expected"), v["reason"].alias("reason"), side.alias("side"))


@query("reject_reasons", """SELECT event_id, CASE WHEN user_id > 100 THEN 'too_long' WHEN value > 50 THEN 'too_large' END AS voice, CASE WHEN value > 80 THEN 'timeout' WHEN event_type = 'error' THEN 'decode_failed' WHEN user_id < 75 THEN 'below_minimum' ELSE 'ok' END AS probe,
    value > 30 AS over_budget FROM events""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = F.col("user_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", N.voice_reject(u + 200, F.when(v > 50, 30_000_000).otherwise(1)).alias("voice"), N.probe_verdict(v > 80, F.col("event_type") != "error", u * 6, u * 7, 450).alias("probe"), (N.over_budget(v, 30.0) & (v > 30)).alias("over_budget"))


@query("change_validation", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_extendedprice - 5000 < 0 THEN 'price_negative' WHEN l_quantity - 3 < 0 THEN 'quantity_negative' WHEN l_returnflag = 'A' THEN 'stock_status_unknown' WHEN l_linestatus = 'F' THEN 'currency_malformed' END AS error FROM lineitem""")
def change_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.operators.merge import validated_change

    status = F.when(F.col("l_returnflag") == "A", "sold").otherwise("in_stock")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", validated_change(F.col("l_extendedprice") - 5000, F.col("l_quantity") - 3, status, F.when(F.col("l_linestatus") == "F", "K").otherwise("czk")).alias("error"))


@query("date_rules", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, strftime(ts, '%d.%m.%Y %H:%M') AS day_first, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS elapsed,
    ts > TIMESTAMP '2024-01-15' AS future, CAST(round(event_id * 1234567 / 1000000.0) AS BIGINT) AS ms, event_id // 60 AS minutes FROM events""")
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    start = F.lit("2024-01-01").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", D.iso(ts).alias("iso"), D.day_first(ts).alias("day_first"), D.elapsed_seconds(start, ts).alias("elapsed"), D.is_future(ts, F.lit("2024-01-15").cast("timestamp")).alias("future"),
        D.milliseconds(F.col("event_id") * 1234567).alias("ms"), D.whole_minutes(F.col("event_id")).alias("minutes"))


@query("json_paths", "SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, CAST(json_extract_string(props, '$.k') AS BIGINT) AS typed FROM events")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", P.path(F.col("props"), "k").alias("k"), P.path(F.col("props"), "missing", default="none").alias("missing"), P.variant_path(F.col("props"), "k", "bigint").alias("typed"))
