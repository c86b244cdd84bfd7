"""Queries over sources, writers and keyed streams: search answers, drop folders, batches, requests and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import html as H
from vitrine.functions import payloads as P
from vitrine.operators import merge as M
from vitrine.operators import usage as A
from vitrine.plans.binding import bound, with_bound
from vitrine.registry import query
from vitrine.session import shared_dir, table
from vitrine.sources import readers, sinks
from vitrine.streaming import intake, state, timers

# ---- sources and writers -----------------------------------------------------------------------


@query("search_results", """SELECT 'File ' || page_id || '-' || i AS title, url || '/' || CASE WHEN page_id % 2 = 0 THEN 'thumb' ELSE 'full' END || i || '.jpg' AS url, CASE WHEN i = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime,
    CAST(CASE WHEN page_id % 2 = 0 THEN 320 ELSE page_id END AS INT) AS width, CAST(CASE WHEN page_id % 2 = 0 THEN 240 ELSE i END AS INT) AS height, CAST(i + 1 AS INT) AS search_rank FROM (SELECT page_id, url, unnest(range(page_id % 3)) AS i FROM pages)""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an image search with none to two pictures each, half of them with thumbnails; every seventh answer comes with a broken one."""
    k, small = F.col("page_id"), F.col("page_id") % 2 == 0

    def picture(i: int) -> Column:
        size = lambda c: F.when(small, F.lit(c))
        info = F.struct(F.concat(F.col("url"), F.lit(f"/full{i}.jpg")).alias("url"), F.lit("image/png" if i else "image/jpeg").alias("mime"), k.cast("int").alias("width"), F.lit(i).alias("height"),
                        F.when(small, F.concat(F.col("url"), F.lit(f"/thumb{i}.jpg"))).alias("thumburl"), size(320).alias("thumbwidth"), size(240).alias("thumbheight"))
        return F.struct(F.concat(F.lit("File "), k.cast("string"), F.lit(f"-{i}")).alias("title"), F.lit(i + 1).alias("index"), F.array(info).alias("imageinfo"))

    found = F.map_filter(F.create_map(F.lit("11"), picture(0), F.lit("12"), picture(1)), lambda _, v: v["index"] <= k % 3)
    body = F.to_json(F.struct(F.struct(found.alias("pages")).alias("query")))
    pages = table(spark, sf_dir, "pages").select(F.explode(F.when(k % 7 == 0, F.array(body, F.lit("{broken"))).otherwise(F.array(body))).alias("body"))
    return readers.search_results(pages)


@query("structured_images", """SELECT page_id, unnest(['/a' || page_id || '.jpg', 'https://x.example/u.png'] || CASE WHEN page_id % 2 = 0 THEN ['/t.webp'] ELSE [] END) AS image FROM pages WHERE page_id % 5 <> 4""")
def structured_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured data with pictures as texts, as objects and under other keys; every fifth document is broken."""
    k = F.col("page_id")
    images = F.concat(F.lit('"image":["/a'), k.cast("string"), F.lit('.jpg",{"@type":"ImageObject","url":"https://x.example/u.png","caption":"no"}]'))
    offers = F.when(k % 2 == 0, ',"offers":{"thumbnailUrl":"/t.webp","price":"1"}').otherwise(',"offers":{"name":"x"}')
    body = F.when(k % 5 == 4, '{"image":').otherwise(F.concat(F.lit('{"@type":"Product","name":"n",'), images, offers, F.lit("}")))
    return H.structured_images(spark, table(spark, sf_dir, "pages").select("page_id", body.alias("body")), "page_id", "body")


@query("edited_payloads", """SELECT s_suppkey, CAST(s_suppkey % 40 AS INT) AS clicks, CAST(700 + s_suppkey AS INT) AS wait, '.s' || s_suppkey AS selector FROM supplier""")
def edited_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form changes one field of a stored document; the protected ones stay."""
    k = F.col("s_suppkey")
    stored = F.concat(F.lit('{"collect_selectors":[".s'), k.cast("string"), F.lit('"],"max_clicks":99,"wait_ms":'), (k + 700).cast("string"), F.lit("}"))
    edited = P.with_fields(stored, "recipe", max_clicks=(k % 40).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", P.parsed(edited, "recipe").alias("r"))
    return rows.select("s_suppkey", F.col("r.max_clicks").alias("clicks"), F.col("r.wait_ms").alias("wait"), F.col("r.collect_selectors")[0].alias("selector"))


@query("fan_out_bodies", "SELECT n_name AS request, CASE WHEN n_nationkey % 6 <> 5 THEN 'body of ' || lower(n_name) END AS body, n_nationkey % 6 = 5 AS failed FROM nation")
def fan_out_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each nation, a task each; the fetcher refuses some of them, which are rows and not failures."""
    names = {r["n_name"]: r["n_nationkey"] for r in table(spark, sf_dir, "nation").select("n_name", "n_nationkey").orderBy("n_nationkey").limit(25).collect()}  # 25 rows

    def fetch(name: str) -> str:
        if names[name] % 6 == 5:
            raise OSError("refused")
        return f"body of {name.lower()}"

    return readers.fan_out(spark, list(names), fetch, "nation_bodies").select("request", "body", F.col("error").isNotNull().alias("failed"))


@query("batches_written_twice", "SELECT event_id % 4 AS batch, event_type, count(*) AS n FROM events GROUP BY ALL")
def batches_written_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in four batches, one of which is written again."""
    folder = shared_dir(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    for batch in (0, 1, 2, 2, 3):
        sinks.append_batch(events.where(F.col("event_id") % 4 == batch), folder, batch)
    return spark.read.parquet(folder).groupBy(F.col("batch").cast("long").alias("batch"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_queued_jobs", "SELECT CASE event_type WHEN 'view' THEN 'voice' WHEN 'click' THEN 'media' ELSE 'assistant' END AS queue, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def stream_queued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that producers append to a folder, read as a stream."""
    folder, zero = shared_dir(spark), F.lit(0).cast("long")
    queue = F.when(F.col("event_type") == "view", "voice").when(F.col("event_type") == "click", "media").otherwise("assistant")
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), queue.alias("queue"), F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("reserved_at"), zero.alias("available_at"), zero.alias("created_at"))
    for part in (0, 1):
        sinks.append(jobs.where(F.col("id") % 2 == part), folder)
    return intake.available_now(readers.queued_jobs(spark, folder), "jobs", "append").groupBy("queue").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("rejected_drafts", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'rejected' WHEN p_size % 3 = 0 THEN 'pending_review' WHEN p_size % 3 = 1 THEN 'approved' ELSE 'rejected' END AS status FROM part")
def rejected_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second draft is turned down, which counts only for those that wait for a review."""
    size = F.col("p_size") % 3
    drafts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(size == 0, "pending_review").when(size == 1, "approved").otherwise("rejected").alias("status"))
    return M.rejected(drafts, drafts.where("id % 2 = 0"))


@query("sync_report", with_bound("SELECT count(*) FILTER (WHERE provider = 'openai') AS available, count(*) FILTER (WHERE provider <> 'openai') AS unavailable FROM ai_models", "ai_models"))
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = bound(spark, sf_dir, "ai_models").withColumn("is_available", F.lit(True))
    return A.sync_report(A.refreshed_models(models, models.where("provider = 'openai'")))


# ---- keyed streams -----------------------------------------------------------------------------


@query("stream_throttled_edits", """WITH RECURSIVE e AS (SELECT user_id, CAST(event_id / 100.0 AS DOUBLE) AS t, event_type = 'purchase' AS final, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT user_id, n, t, final, t AS last, true AS passed FROM e WHERE n = 1 UNION ALL
      SELECT e.user_id, e.n, e.t, e.final, CASE WHEN e.final OR e.t - r.last >= 1.2::DOUBLE THEN e.t ELSE r.last END, e.final OR e.t - r.last >= 1.2::DOUBLE FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
    SELECT user_id AS message_id, t AS at, final FROM r WHERE passed""")
def stream_throttled_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of a message for each user, a hundred a second in all; purchases are final."""
    edits = intake.events_stream(spark, sf_dir).select(F.col("user_id").alias("message_id"), (F.col("event_id") / 100.0).cast("double").alias("at"), (F.col("event_type") == "purchase").alias("final"))
    return intake.available_now(state.throttled(edits), "edits", "append")


_REQUESTS_ONCE = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id * 7 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT key, n, t, t AS last FROM e WHERE n = 1 UNION ALL SELECT e.key, e.n, e.t, CASE WHEN e.t - r.last >= 720 THEN e.t ELSE r.last END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
    SELECT key, t AS at FROM r WHERE t = last"""


@query("stream_requests_once", _REQUESTS_ONCE)
def stream_requests_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user, of which a flag lets one pass in twelve minutes."""
    requests = intake.events_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), (F.col("event_id") * 7).alias("at"))
    return intake.available_now(state.deduplicated_requests(requests), "requests", "append")


@query("stream_conversation_turns", """WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS fresh FROM events),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM c)
    SELECT CAST(user_id AS VARCHAR) AS chat_id, event_id AS id, event_type AS model, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS turn FROM i""")
def stream_conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a chat for each user; the number of turns starts over when the model changes."""
    events = intake.events_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("chat_id"), F.col("event_id").alias("id"), F.col("event_type").alias("model"))
    return intake.available_now(state.conversation_models(events), "turns", "append")


@query("stream_requests_expiring", _REQUESTS_ONCE)
def stream_requests_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests, by flags that timers take down."""
    requests = intake.events_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), (F.col("event_id") * 7).alias("at"))
    return timers.worked_through(timers.requests_once(requests), "requests")


@query("stream_results_kept", "SELECT user_id || '-' || event_type AS idempotency_key, min(event_id) AS id, count(*) AS n, count(*) - 1 AS repeated FROM events GROUP BY ALL")
def stream_results_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of each user and kind run once while the result is kept."""
    rows = intake.events_stream(spark, sf_dir).select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("idempotency_key"), F.col("event_id").alias("id"), F.lit("done").alias("result"))
    done = timers.worked_through(timers.executed_once(rows), "kept", timers=False)
    return done.groupBy("idempotency_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.count_if("repeated").alias("repeated"))


@query("stream_leases", """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, event_id * 3 AS t, least(10 + (event_id * 37) % 900, 600) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT key, id, n, t AS asked_at, t AS granted_at, t + s AS released_at FROM e WHERE n = 1 UNION ALL
      SELECT e.key, e.id, e.n, e.t, greatest(e.t, r.released_at), greatest(e.t, r.released_at) + e.s FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
    SELECT key, id, asked_at, granted_at, released_at, granted_at > asked_at AS busy FROM r""")
def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a job of its user, who has one at a time; a last job of another user, days later, lets all leases end."""
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), (F.col("event_id") * 3).alias("at"), (10 + F.col("event_id") * 37 % 900).alias("seconds"))
    folder, out = shared_dir(spark), shared_dir(spark)
    stream = lambda: timers.leases(spark.readStream.schema(jobs.schema).parquet(folder), 600)
    jobs.write.parquet(folder)
    timers.worked_through(stream(), "leases", out)
    last = jobs.agg(F.lit("last").alias("key"), F.lit(-1).cast("long").alias("id"), (F.max("at") + F.sum("seconds")).alias("at"), F.lit(0).cast("long").alias("seconds"))
    last.write.mode("append").parquet(folder)
    return timers.worked_through(stream(), "leases", out).where("key <> 'last'")
