"""Queries over references, exclusions, polled readings, requests and programs."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import references as R
from vitrine.operators import requests as Q
from vitrine.operators.exclusions import Exclusions
from vitrine.plans.change_queries import _BITS, _hashes
from vitrine.plans.text_queries import PAGE_GALLERY_SQL, page_gallery
from vitrine.registry import query
from vitrine.session import folder_exists, shared_dir, table
from vitrine.sources import polling, readers
from vitrine.streaming import intake

# ---- polling -----------------------------------------------------------------------------------


@query("polled_changes", """SELECT name, value, "at" FROM (SELECT CAST(user_id AS VARCHAR) AS name, event_type AS value, event_id AS "at", lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    WHERE value IS DISTINCT FROM before""")
def polled_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each user's latest event as a polled value; the stream ends after the first half of the readings and starts again for the rest."""
    folder, out = shared_dir(spark), shared_dir(spark)
    events = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("value"), F.col("event_id").alias("at"))).alias("line"), "event_id")
    half = events.agg(F.floor(F.max("event_id") / 2)).first()[0] or 0
    for part, rule in (("1", F.col("event_id") <= half), ("2", F.col("event_id") > half)):
        events.where(rule).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("line").write.text(f"{folder}/{part}")
        intake.polled(polling.readings(spark, folder), out, "changes", interval=None).awaitTermination()
    schema = "name string, value string, at long"
    return spark.read.schema(f"{schema}, batch long").parquet(f"{out}/changes").drop("batch") if folder_exists(spark, f"{out}/changes") else spark.createDataFrame([], schema)


# ---- exclusions --------------------------------------------------------------------------------

_EXCLUDED = """SELECT user_id AS draft_id, CASE WHEN event_type = 'click' THEN 'image' ELSE 'source' END AS kind, 'https://x.example/' || (event_id % 40) AS value FROM events WHERE event_type IN ('click', 'view')"""


@query("draft_exclusions", f"SELECT DISTINCT * FROM ({_EXCLUDED})")
def draft_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that users click and view, excluded for their drafts in three batches that overlap, one of them sent twice, and compacted."""
    kind = F.when(F.col("event_type") == "click", "image").otherwise("source")
    rows = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')").select("event_id", F.col("user_id").alias("draft_id"), kind.alias("kind"), F.concat(F.lit(" https://x.example/"), (F.col("event_id") % 40).cast("string")).alias("value"))
    kept = Exclusions(spark, shared_dir(spark))
    for batch in (0, 1, 1, 2):
        kept.add(f"{batch:04d}", rows.where(F.col("event_id") % 4 >= batch))
    return kept.compact(shared_dir(spark)).rows().select("draft_id", "kind", "value")


@query("selection_with_exclusions", f"""WITH RECURSIVE {_BITS}, g AS (SELECT id, bits, id // 20 AS owner, row_number() OVER (PARTITION BY id // 20 ORDER BY id) AS n FROM h),
    f AS (SELECT owner, 0::BIGINT AS n, []::BIGINT[] AS kept, list(bits) FILTER (id % 10 = 3) AS seen FROM g GROUP BY owner UNION ALL
      SELECT owner, n, CASE WHEN near THEN kept ELSE list_append(kept, id) END, CASE WHEN near THEN seen ELSE list_append(seen, bits) END
      FROM (SELECT f.owner, x.n, f.kept, coalesce(f.seen, []) AS seen, x.id, x.bits, len(list_filter(coalesce(f.seen, []), lambda s: list_sum([CASE WHEN s[i] <> x.bits[i] THEN 1 ELSE 0 END for i in range(1, 65)]) <= 24)) > 0 AS near FROM f JOIN g x ON x.owner = f.owner AND x.n = f.n + 1))
    SELECT owner AS draft_id, unnest(kept) AS pos FROM f WHERE n = (SELECT max(n) FROM g WHERE g.owner = f.owner)""")
def selection_with_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in drafts of twenty, of which the third and thirteenth were excluded before, with all that resemble them."""
    images = _hashes(spark, sf_dir).select(F.floor(F.col("id") / 20).alias("draft_id"), F.col("id").alias("pos"), "high", "low")
    kept = Exclusions(spark, shared_dir(spark)).add("0001", hashes=images.where("pos % 10 = 3"))
    return kept.chosen(images, 24).select("draft_id", "pos")


# ---- references --------------------------------------------------------------------------------


@query("pages_of_picks", """
    WITH found AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1), picks AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT p.event_id AS pick_id, 'https://i.example/' || p.user_id AS url, 'https://p.example/' || lpad(CAST(f.event_id AS VARCHAR), 12, '0') AS page FROM picks p ASOF JOIN found f ON f.user_id = p.user_id AND f.ts <= p.ts WHERE p.ts - f.ts < INTERVAL 2 DAY""")
def pages_of_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are finds of a user's picture on a page, purchases are picks of it."""
    url = F.concat(F.lit("https://i.example/"), F.col("user_id").cast("string"))
    page = F.concat(F.lit("https://p.example/"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    found = intake.events_stream(spark, sf_dir).where("event_type = 'view'").select(url.alias("url"), page.alias("page"), F.col("ts").alias("found_at"))
    picks = intake.events_stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("pick_id"), url.alias("url"), F.col("ts").alias("picked_at"))
    return R.pages_of_picks(found, picks, "2 days").select("pick_id", "url", "page")


@query("operation_targets", """
    WITH ops AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'order' WHEN 'click' THEN 'part' WHEN 'error' THEN 'gone' END AS target_type, CAST(event_id % 900 AS BIGINT) AS target_id FROM events)
    SELECT ops.id, target_type, CASE WHEN o.o_orderkey IS NOT NULL THEN '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' WHEN p.p_partkey IS NOT NULL THEN '{"id":' || p_partkey || ',"name":"' || p_name || '"}' END AS target
    FROM ops LEFT JOIN orders o ON target_type = 'order' AND o_orderkey = target_id LEFT JOIN part p ON target_type = 'part' AND p_partkey = target_id""")
def operation_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on orders, parts and things that are not kept, by type and id."""
    kind = F.when(F.col("event_type") == "purchase", "order").when(F.col("event_type") == "click", "part").when(F.col("event_type") == "error", "gone")
    operations = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("target_type"), (F.col("event_id") % 900).alias("target_id"))
    targets = {
        "order": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), "part": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")),
    }
    return R.resolved(operations, targets).select("id", "target_type", "target")


_MOVES = """moves AS (SELECT page_id, 'https://w' || (page_id % 97) || '.example/p/' || page_id AS url, CASE WHEN page_id % 7 IN (0, 1, 2, 3) THEN 302 WHEN page_id % 41 = 5 THEN 500 ELSE 200 END AS status,
      CASE WHEN page_id % 23 = 0 THEN NULL WHEN page_id % 19 = 0 THEN 'http://127.0.0.1/admin' WHEN page_id % 17 = 0 THEN 'https://nowhere.example/' WHEN page_id % 13 = 0 THEN CAST(page_id AS VARCHAR)
           ELSE '//w' || ((page_id + 1) % 97) || '.example/p/' || (page_id + 1) END AS location FROM pages)"""


@query("pages_redirected", f"""WITH RECURSIVE {_MOVES}, walk AS (
      SELECT page_id, url AS place, 0 AS hops, CAST(NULL AS VARCHAR) AS refused, true AS open FROM moves UNION ALL
      SELECT page_id, CASE WHEN v IS NOT NULL OR status < 300 OR hops = 3 THEN place WHEN location LIKE '//%' THEN 'https:' || location WHEN location LIKE 'http%' THEN location ELSE regexp_replace(place, '[^/]*$', '') || location END,
             CASE WHEN v IS NOT NULL OR status < 300 OR hops = 3 THEN hops ELSE hops + 1 END, CASE WHEN v IS NULL AND status BETWEEN 300 AND 399 AND hops = 3 THEN 'too_many' ELSE v END, v IS NULL AND status BETWEEN 300 AND 399 AND hops < 3
      FROM (SELECT w.*, m.status, m.location, CASE WHEN w.place LIKE 'http://127.%' THEN 'blocked' WHEN m.url IS NULL THEN 'missing' WHEN m.status BETWEEN 300 AND 399 AND m.location IS NULL THEN 'no_location' WHEN m.status >= 400 THEN 'failed' END AS v
            FROM walk w LEFT JOIN moves m ON m.url = w.place WHERE w.open))
    SELECT page_id, place AS final_url, CAST(hops AS INT) AS hops, refused FROM walk WHERE NOT open""")
def pages_redirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which most have moved: to the next page, to themselves, to a private address, to nowhere, or without saying where."""
    k = F.col("page_id")
    url = lambda n: F.concat(F.lit("//w"), (n % 97).cast("string"), F.lit(".example/p/"), n.cast("string"))
    location = F.when(k % 23 == 0, None).when(k % 19 == 0, "http://127.0.0.1/admin").when(k % 17 == 0, "https://nowhere.example/").when(k % 13 == 0, k.cast("string")).otherwise(url(k + 1))
    status = F.when((k % 7).isin(0, 1, 2, 3), 302).when(k % 41 == 5, 500).otherwise(200)
    moves = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https:"), url(k)).alias("url"), status.alias("status"), location.alias("location"))
    return R.redirected(moves.select("page_id", "url"), moves.select("url", "status", "location")).select("page_id", "final_url", "hops", "refused")


@query("gallery_diagnostics", f"""SELECT count(*) AS candidates, count(*) FILTER (pos = 1) AS pages, count(*) FILTER (image LIKE '%.webp') AS meta_candidates, max(pos) AS longest, count(*) AS kept FROM ({PAGE_GALLERY_SQL})""")
def gallery_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the extraction of galleries counts on its way."""
    rows, seen = R.with_diagnostics(
        page_gallery(spark, sf_dir), "galleries", candidates=F.count(F.lit(1)), pages=F.count_if(F.col("pos") == 1), meta_candidates=F.count_if(F.col("image").endswith(".webp")), longest=F.max("pos"))
    return seen.withColumn("kept", F.lit(rows.count()))


# ---- requests ----------------------------------------------------------------------------------

_REQUESTS = """r AS (SELECT p_partkey, repeat(p_name, p_size) AS search, list_transform(range(p_size + 2), lambda i: p_brand || i) AS brands, [repeat('x', CAST(p_partkey % 170 AS INT))] AS ram,
      CASE p_partkey % 6 WHEN 0 THEN '-5' WHEN 1 THEN 'abc' WHEN 2 THEN '12.5' WHEN 3 THEN '' WHEN 4 THEN '1e3' END AS min_price, CASE p_partkey % 5 WHEN 0 THEN 'newest' WHEN 1 THEN 'price_asc' WHEN 2 THEN 'best' ELSE '' END AS sort,
      CASE p_partkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '2' WHEN 2 THEN '1.5' WHEN 3 THEN 'x' END AS page, CAST(p_partkey % 60 AS VARCHAR) AS per_page FROM part)"""


@query("requests_judged", f"""WITH {_REQUESTS}, j AS (SELECT *, list_filter([
      CASE WHEN length(search) > 120 THEN 'search: longer than 120' END, CASE WHEN len(brands) > 50 THEN 'brands: more than 50' END, CASE WHEN length(ram[1]) > 160 THEN 'attributes: item longer than 160' END,
      CASE min_price WHEN 'abc' THEN 'min_price: not a number' WHEN '-5' THEN 'min_price: below 0' END, CASE WHEN sort = 'best' THEN 'sort: unknown' END,
      CASE page WHEN '0' THEN 'page: below 1' WHEN '1.5' THEN 'page: not a whole number' WHEN 'x' THEN 'page: not a whole number' END, CASE WHEN p_partkey % 60 = 0 THEN 'per_page: below 1' WHEN p_partkey % 60 > 50 THEN 'per_page: above 50' END], lambda x: x IS NOT NULL) AS e FROM r)
    SELECT p_partkey, array_to_string(e, '; ') AS errors, CASE WHEN len(e) = 0 THEN coalesce(nullif(sort, ''), 'newest') END AS sort, CASE WHEN len(e) = 0 THEN coalesce(CAST(page AS INT), 1) END AS page, CASE WHEN len(e) = 0 THEN len(brands) END AS n_brands,
      concat_ws('&', CASE WHEN p_partkey % 170 > 0 THEN 'attributes.ram[]=' || ram[1] END, array_to_string(list_transform(brands, lambda b: 'brands[]=' || replace(b, '#', '%23')), '&'), CASE WHEN min_price <> '' THEN 'min_price=' || min_price END, CASE WHEN page IS NOT NULL THEN 'page=' || page END,
        CASE WHEN per_page <> '12' THEN 'per_page=' || per_page END, 'search=' || replace(search, ' ', '+'), CASE WHEN sort NOT IN ('', 'newest') THEN 'sort=' || sort END) AS link FROM j""")
def requests_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with long searches and lists, and numbers, orders and pages of all kinds."""
    k, one = F.col("p_partkey"), lambda c: F.array(c.cast("string"))
    price = F.when(k % 6 == 0, "-5").when(k % 6 == 1, "abc").when(k % 6 == 2, "12.5").when(k % 6 == 3, " ").when(k % 6 == 4, "1e3")
    sort = F.when(k % 5 == 0, "newest").when(k % 5 == 1, "price_asc").when(k % 5 == 2, "best").otherwise("")
    page = F.when(k % 7 == 0, "0").when(k % 7 == 1, "2").when(k % 7 == 2, "1.5").when(k % 7 == 3, "x")
    brands = F.transform(F.sequence(F.lit(0), F.col("p_size") + 1), lambda i: F.concat("p_brand", i.cast("string")))
    parameters = F.create_map(
        F.lit("search"), one(F.repeat("p_name", F.col("p_size"))), F.lit("brands"), brands, F.lit("attributes.ram"), one(F.repeat(F.lit("x"), (k % 170).cast("int"))), F.lit("min_price"), one(price), F.lit("sort"), one(sort), F.lit("page"), one(page),
        F.lit("per_page"), one(k % 60), F.lit("category"), F.array().cast("array<string>"))
    judged = Q.judged(table(spark, sf_dir, "part").select("p_partkey", parameters.alias("parameters")))
    return judged.select("p_partkey", F.array_join("errors", "; ").alias("errors"), "echo.sort", "echo.page", F.size("echo.brands").alias("n_brands"), "link")


@query("seeded_regions", "SELECT r_name AS name, 'region ' || r_regionkey AS comment, false AS seeded FROM region UNION ALL SELECT * FROM (VALUES ('ARCTIC', 'seed', true), ('OCEANIA', NULL, true)) v")
def seeded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed rows, of which those whose name is there already change nothing."""
    kept = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("comment"), F.lit(False).alias("seeded"))
    seeds = readers.literal_rows(spark, "name string, comment string, seeded boolean", ("ARCTIC", "seed", True), ("OCEANIA", None, True), ("ASIA", "seed", True))
    return kept.unionByName(seeds.join(kept, "name", "left_anti"))


# ---- programs ----------------------------------------------------------------------------------

#: Answers each line with the numbers of characters and links of the page in it.
_COUNTING = "import json, sys\nfor line in sys.stdin:\n    page = json.loads(line)\n    print(json.dumps({'page_id': page['page_id'], 'chars': len(page['html']), 'links': page['html'].count('<a ')}), flush=True)"


@query("pages_by_program", "SELECT page_id, length(html) AS chars, (length(html) - length(replace(html, '<a ', ''))) // 3 AS links, NULL::VARCHAR AS error FROM pages")
def pages_by_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page goes through a program that a task keeps running."""
    tasks = table(spark, sf_dir, "pages").select(F.to_json(F.struct("page_id", "html")).alias("payload"))
    answers = readers.from_program(tasks, [sys.executable, "-c", _COUNTING])
    return answers.select(F.from_json("output", "page_id long, chars long, links long").alias("a"), "error").select("a.*", "error")
