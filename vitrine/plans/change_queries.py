"""Set, duplicate, merge, draft and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import numbers as N
from vitrine.functions import payloads as P
from vitrine.functions import text as T
from vitrine.operators import merge as M
from vitrine.operators import selection as X
from vitrine.operators import sources as S
from vitrine.operators import windows as W
from vitrine.plans.binding import bound, with_bound
from vitrine.registry import query
from vitrine.schemas import TABLES
from vitrine.session import shared_dir, table
from vitrine.sources import readers
from vitrine.streaming import intake, state

# ---- sets --------------------------------------------------------------------------------------


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k"))


_C, _S = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_suppkey % 3 = 0"


@query("set_union", f"{_C} UNION {_S}")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.unionByName(b).distinct()


@query("set_union_all", f"SELECT k, count(*) AS n FROM ({_C} UNION ALL {_S}) GROUP BY k")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.unionByName(b).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("set_except", f"{_C} EXCEPT {_S}")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.subtract(b)


@query("set_intersect", f"{_C} INTERSECT {_S}")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersect(b)


@query("set_arrays", "SELECT s_suppkey, list_sort(list_distinct([s_suppkey, 1, 2, 3, 9])) AS joined, list_sort(list_filter([1, 2, 3], lambda x: x <> s_suppkey)) AS without, list_filter([1, 2, 3], lambda x: x = s_suppkey) AS common, [3, 2, 1] AS reversed, 2 AS place, true AS any_two, false AS all_two FROM supplier")
def set_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, three = F.array("s_suppkey"), F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.array_sort(P.union_in_order(own, three, F.array(F.lit(9).cast("long")))).alias("joined"), F.array_except(three, own).alias("without"), F.array_intersect(three, own).alias("common"),
        F.reverse(three).alias("reversed"), F.array_position(three, F.lit(2).cast("long")).cast("int").alias("place"), F.exists(three, lambda x: x == 2).alias("any_two"), F.forall(three, lambda x: x == 2).alias("all_two"))


@query("set_distinct_by_key", "SELECT lower(c_mktsegment) AS segment, c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL")
def set_distinct_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("segment", F.lower("c_mktsegment"))
    from vitrine.operators.catalog import first_per

    return first_per(rows, ["segment", "c_nationkey"], F.col("c_custkey")).select("segment", "c_nationkey", "c_custkey")


@query("maps_and_defaults", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 5 ELSE 3 END AS target, coalesce(CASE WHEN p_size % 2 = 0 THEN 'x' END, '-') AS kept FROM part")
def maps_and_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = P.without_nulls(F.create_map(F.lit("a"), F.when(F.col("p_size") % 2 == 0, "x"), F.lit("b"), F.lit("y")))
    return table(spark, sf_dir, "part").select("p_partkey", N.target_images(F.when(F.col("p_size") % 3 == 0, "laptop").otherwise("other")).alias("target"), F.coalesce(F.try_element_at(P.sorted_map(changes), F.lit("a")), F.lit("-")).alias("kept"))


@query("conditional_counts", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, max(o_orderdate) AS latest, min(o_orderdate) AS earliest, bool_and(o_totalprice > 2000) AS all_large, bool_or(o_totalprice > 400000) AS any_large, greatest(count(*) FILTER (WHERE o_orderstatus = 'F'), count(*) FILTER (WHERE o_orderstatus = 'O')) AS top FROM orders GROUP BY 1")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished, opened = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), finished.alias("finished"), F.max("o_orderdate").alias("latest"), F.min("o_orderdate").alias("earliest"), F.bool_and(F.col("o_totalprice") > 2000).alias("all_large"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"), F.greatest(finished, opened).alias("top"))


@query("text_aggregates", "SELECT n_regionkey, string_agg(n_name, ' · ' ORDER BY n_nationkey) AS line, string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS block FROM nation GROUP BY 1")
def text_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), " · ")
    block = F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.concat(F.lit("- "), x)), "\n")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(line.alias("line"), block.alias("block"))


# ---- duplicates and selection ------------------------------------------------------------------


@query("exact_dedup", "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exact_distinct(table(spark, sf_dir, "documents"), "text", "doc_id")


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("embedding")[i] > F.col("embedding")[(i + 1) % 64]).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", N.hash_halves(bits).alias("h")).select("id", "label", "h.high", "h.low")


_BITS = "h AS (SELECT vec_id AS id, label, [CASE WHEN embedding[i] > embedding[(i % 64) + 1] THEN 1 ELSE 0 END for i in range(1, 65)] AS bits FROM embeddings)"
_DISTANCE = "list_sum([CASE WHEN a.bits[i] <> b.bits[i] THEN 1 ELSE 0 END for i in range(1, 65)])"


@query("hash_hamming_pairs", f"WITH {_BITS} SELECT a.id AS a, b.id AS b, CAST({_DISTANCE} AS INT) AS distance FROM h a JOIN h b ON a.id < b.id AND {_DISTANCE} <= 16 WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.bits = a.bits AND c.id < a.id) AND NOT EXISTS (SELECT 1 FROM h c WHERE c.bits = b.bits AND c.id < b.id)")
def hash_hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.near_pairs(_hashes(spark, sf_dir), 16)


@query("hash_hex", f"WITH {_BITS} SELECT id, len(list_filter(bits, lambda x: x = 1)) AS ones FROM h")
def hash_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits through the hexadecimal form and back."""
    back = N.hex_halves(N.hash_hex(F.struct("high", "low")))
    zero = F.struct(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))
    return _hashes(spark, sf_dir).select("id", N.hamming(back, zero).cast("long").alias("ones"))


@query("near_dup_greedy", f"""WITH RECURSIVE {_BITS}, g AS (SELECT id, bits, id // 20 AS owner, row_number() OVER (PARTITION BY id // 20 ORDER BY id) AS n FROM h),
    f AS (SELECT owner, n, [id] AS kept, [bits] AS seen FROM g WHERE n = 1 UNION ALL
      SELECT g.owner, g.n, CASE WHEN near THEN f.kept ELSE list_append(f.kept, g.id) END, CASE WHEN near THEN f.seen ELSE list_append(f.seen, g.bits) END
      FROM (SELECT f.owner, f.n, f.kept, f.seen, len(list_filter(f.seen, lambda s: list_sum([CASE WHEN s[i] <> x.bits[i] THEN 1 ELSE 0 END for i in range(1, 65)]) <= 24)) > 0 AS near FROM f JOIN g x ON x.owner = f.owner AND x.n = f.n + 1) f JOIN g ON g.owner = f.owner AND g.n = f.n + 1)
    SELECT owner, unnest(kept) AS pos FROM f WHERE n = (SELECT max(n) FROM g WHERE g.owner = f.owner)""")
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures in products of twenty, as many as a draft has at most."""
    images = _hashes(spark, sf_dir).select(F.floor(F.col("id") / 20).alias("owner"), F.col("id").alias("pos"), "high", "low")
    return X.without_near_duplicates(images, "owner", None, 24).select("owner", "pos")


@query("best_per_key", "SELECT l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS n FROM lineitem) WHERE n = 1")
def best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber")).select("l_partkey", "l_suppkey", "l_extendedprice", "pos")
    return X.best_per_key(rows, ["l_partkey"], "l_extendedprice", "pos").select("l_partkey", "l_suppkey", "l_extendedprice")


@query("best_partial_gallery", "SELECT user_id, max(n) AS n_images, arg_max(event_type, (n, -pos)) AS gallery, bool_and(n < 8) AS all_partial FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS pos FROM events GROUP BY ALL) GROUP BY user_id")
def best_partial_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("gallery")).agg(F.count(F.lit(1)).alias("n_images"), F.min("event_id").alias("pos"))
    return X.best_partial(g.withColumn("partial", F.col("n_images") < 8), "user_id").select("user_id", "n_images", "gallery", "all_partial")


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        "doc_id", F.col("doc_id").alias("index"), (F.col("quality") == 1).alias("publishable"), (F.col("toxic") == 0).alias("color_match"), (F.col("lang") == "en").alias("exact_match"), (F.col("doc_id") % 2 == 0).alias("supported"),
        F.when(F.col("lang") == "de", "diagram").otherwise("product").alias("kind"), F.when(F.col("source") == "src0", "front").otherwise("side").alias("view"), (F.col("n_chars") % 101).alias("score"), (F.col("n_chars") % 7).alias("gallery_rank"))


_REVIEWS = """r AS (SELECT doc_id, quality = 1 AS publishable, toxic = 0 AS color_match, lang = 'en' AS exact_match, doc_id % 2 = 0 AS supported, CASE WHEN lang = 'de' THEN 'diagram' ELSE 'product' END AS kind, CASE WHEN source = 'src0' THEN 'front' ELSE 'side' END AS view, n_chars % 101 AS score, n_chars % 7 AS gallery_rank
      FROM documents JOIN labels USING (doc_id)), ok AS (SELECT * FROM r WHERE publishable AND color_match AND kind = 'product' AND score >= 60 AND (exact_match OR supported))"""


@query("review_acceptance", f"WITH {_REVIEWS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY CASE WHEN view = 'front' THEN 1 ELSE 0 END DESC, exact_match DESC, supported DESC, score DESC, doc_id) AS INT) AS place, CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY gallery_rank, score DESC, doc_id) AS INT) AS gallery_place FROM ok")
def review_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    ok = _reviews(spark, sf_dir).where(X.accepted(F.lit(True), F.col("supported")))
    one = Window.partitionBy(F.floor(F.col("doc_id") / 20))  # the reviews of one batch of pictures
    return ok.select("doc_id", F.row_number().over(one.orderBy(*X.review_order())).alias("place"), F.row_number().over(one.orderBy(*X.gallery_order())).alias("gallery_place"))


@query("positional_reviews", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = user_id % 20 + 1")
def positional_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("pos"))
    reviews = rows.select("user_id").distinct().withColumn("index", (F.col("user_id") % 20 + 1).cast("int"))
    return X.reviewed(rows, reviews, "user_id").select("user_id", "event_id")


@query("asset_candidates", """WITH c AS (SELECT page_id, unnest([0, 1, 2]) AS i FROM pages) SELECT page_id, i FROM c WHERE CASE page_id % 3 WHEN 0 THEN i <= 1 WHEN 1 THEN i >= 1 ELSE true END AND NOT (page_id % 5 = 0 AND i = 2)""")
def asset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page three pictures: two priority ones, two in the gallery, or neither; every fifth page's last one is a video still."""
    k = F.col("page_id")
    c = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*map(F.lit, range(3)))).alias("i")).withColumn("url", F.concat(F.lit("https://x.example/"), F.col("page_id").cast("string"), F.lit("/"), F.col("i").cast("string"), F.lit(".jpg?w=90")))
    big = F.regexp_replace("url", "w=90", "w=900")
    priority, dom, media = c.where((k % 3 == 0) & (F.col("i") <= 1)), c.where((k % 3 == 1) & (F.col("i") >= 1)).withColumn("url", big), c.where((k % 5 == 0) & (F.col("i") == 2)).withColumn("url", big)
    return X.candidates_by_asset(dom, c, priority, media, "page_id").select("page_id", "i")


# ---- changes -----------------------------------------------------------------------------------


@query("upsert_settings", "SELECT coalesce(n.k, o.k) AS key, coalesce(n.v, o.v) AS value FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15) o FULL JOIN (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE lower(n_name) END AS v FROM nation WHERE n_nationkey >= 10) n ON o.k = n.k")
def upsert_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    old = nation.where("n_nationkey < 15").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    new = nation.where("n_nationkey >= 10").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 4 != 0, F.lower("n_name")).alias("value"))
    return M.upsert(old, new, ["key"])


@query("upsert_higher_confidence", "SELECT p_partkey AS id, CAST(greatest(p_size, 25) AS DOUBLE) / 100 AS confidence, p_size % 2 = 0 AS first_kept FROM part")
def upsert_higher_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 100).cast("decimal(5,4)").alias("confidence"), F.when(F.col("p_size") % 2 == 0, F.lit("2020-01-01")).alias("published_at"))
    new = part.select(F.col("p_partkey").alias("id"), F.lit("0.25").cast("decimal(5,4)").alias("confidence"))
    out = M.upsert(old, new, ["id"], {"confidence": M.higher_confidence(), "published_at": M.first_published(F.lit("2024-01-01"))})
    return out.select("id", F.col("confidence").cast("double").alias("confidence"), (F.col("published_at") == "2020-01-01").alias("first_kept"))


@query("insert_if_absent", "SELECT k, max(old) AS old FROM (SELECT c_nationkey AS k, true AS old FROM customer WHERE c_nationkey < 10 UNION ALL SELECT s_nationkey, false FROM supplier) GROUP BY k")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_nationkey").alias("k"), F.lit(True).alias("old")).distinct()
    new = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(False).alias("old"))
    return M.insert_if_absent(old, new, ["k"])


@query("stage_replace", """WITH o AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS c FROM lineitem WHERE l_linestatus = 'O'), n AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS c FROM lineitem WHERE l_returnflag = 'R')
    SELECT coalesce(o.p, n.p) AS p, coalesce(o.c, n.c) AS c, CASE WHEN o.p IS NOT NULL AND n.p IS NOT NULL THEN 'keep' WHEN n.p IS NOT NULL THEN 'add' WHEN o.p NOT IN (SELECT p FROM n) THEN 'keep' ELSE 'drop' END AS action FROM o FULL JOIN n ON o.p = n.p AND o.c = n.c""")
def stage_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("c"), "l_linestatus", "l_returnflag")
    return M.staged_actions(rows.where("l_linestatus = 'O'"), rows.where("l_returnflag = 'R'"), ["p", "c"])


@query("delete_effects", "SELECT 'cascade' AS action, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT 'null', count(*) FROM orders WHERE o_custkey % 7 = 0 UNION ALL SELECT 'restrict', count(*) FROM orders WHERE o_custkey % 7 = 0")
def delete_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    gone = orders.where("o_custkey % 7 = 0").select(F.col("o_custkey").alias("id")).distinct()
    left, nulled, bars = (M.on_delete(orders, gone, "o_custkey", a) for a in ("cascade", "null", "restrict"))
    tag = lambda rows, name: rows.agg(F.lit(name).alias("action"), F.count(F.lit(1)).alias("n")).select("action", "n")
    return tag(left, "cascade").unionByName(tag(nulled.where("o_custkey IS NULL"), "null")).unionByName(tag(bars, "restrict"))


@query("conditional_update", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.update_where(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 200000, o_orderstatus=F.lit("X")).select("o_orderkey", "o_orderstatus")


@query("unique_slugs", "SELECT p_partkey AS id, CASE WHEN n = 1 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1) THEN slug ELSE slug || '-' || p_partkey END AS slug FROM (SELECT *, replace(p_name, ' ', '-') AS slug, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part WHERE p_size > 1)")
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.slug(F.col("p_name")).alias("slug"), "p_size")
    return M.unique_slugs(part.where("p_size > 1").drop("p_size"), part.where("p_size = 1")).select("id", "slug")


@query("restore_versions", "SELECT o_orderkey AS id, o_custkey AS recipe_id, 'train' AS trigger FROM orders UNION ALL SELECT CAST(10000000 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT), o_custkey, 'restore' FROM orders WHERE o_orderstatus = 'P'")
def restore_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("recipe_id"), F.lit("train").alias("trigger"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), "o_orderstatus")
    wanted = log.where("o_orderstatus = 'P'")
    return M.restored(log.drop("o_orderstatus"), wanted, F.lit(10_000_000).cast("long"), F.lit("2024-02-01").cast("timestamp")).select("id", "recipe_id", "trigger")


@query("two_phase_deletions", """WITH p AS (SELECT event_id AS request, user_id, ts FROM events WHERE event_type = 'signup'), a AS (SELECT p.request, e.event_type, e.ts, e.event_id FROM p JOIN events e ON e.user_id = p.user_id AND e.event_type IN ('purchase', 'error') AND e.ts >= p.ts AND e.event_id > p.request)
    SELECT p.request, CASE (SELECT arg_min(event_type, (ts, event_id)) FROM a WHERE a.request = p.request) WHEN 'purchase' THEN 'deleted' WHEN 'error' THEN 'cancelled' ELSE 'pending' END AS state FROM p""")
def two_phase_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "prepare").when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "cancel")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit(1).alias("product_id"), "user_id", F.lit(1).alias("chat_id"), action.alias("action"), F.col("ts").alias("at"))
    return M.deletions(rows).select("request", "state")


# ---- drafts ------------------------------------------------------------------------------------

def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nested drafts: two of a name and brand describe one product."""
    part = table(spark, sf_dir, "part")
    spec = lambda key, value: F.struct(F.lit(key.lower()).alias("key"), F.lit(key).alias("name"), value.alias("value"))
    source = F.struct(F.lit("Shop").alias("title"), F.concat(F.lit("https://www.shop.example/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("url"), F.lit("retailer").alias("type"), F.array().cast("array<string>").alias("image_urls"))
    size = F.col("p_size").cast("string")
    rows = part.select(
        F.col("p_partkey").alias("id"), F.lit("pending_review").alias("status"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 4 == 0, "laptop").otherwise("gadget").alias("product_type"),
        F.when(F.col("p_size") % 2 == 0, "black").alias("color"), F.lit("A plain product").alias("description"), F.array(spec("RAM", F.concat(size, F.lit(" GB"))), spec("Weight", F.concat(size, F.lit(" g")))).alias("specifications"), F.array(source).alias("sources"),
        (F.col("p_size") / 100).cast("decimal(5,4)").alias("confidence"))
    missing = [f for f in spark.createDataFrame([], TABLES["drafts"]).schema.fields if f.name not in rows.columns]
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def _approved(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    categories = spark.createDataFrame([(1, "laptops"), (2, "computers"), (3, "components"), (4, "other-tech")], "id long, slug string")
    return M.approved(_drafts(spark, sf_dir), categories, F.lit("2024-01-01").cast("timestamp"))


_KEY = "trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-')"


@query("approved_products", f"SELECT {_KEY} AS canonical_key, CASE WHEN arg_max(p_size, p_partkey) % 4 = 0 THEN 1 ELSE 4 END AS category_id, CASE WHEN arg_max(p_size, p_partkey) % 4 = 0 THEN 'laptop' ELSE 'other' END AS product_type, CAST(max(p_size) AS DOUBLE) / 100 AS confidence, 'A plain product' AS description FROM part GROUP BY 1")
def approved_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approved(spark, sf_dir)["products"].select("canonical_key", "category_id", "product_type", F.col("confidence").cast("double").alias("confidence"), "description")


@query("approved_values", f"""WITH k AS (SELECT {_KEY} AS canonical_key, arg_max(p_size, p_partkey) AS size FROM part GROUP BY 1)
    SELECT canonical_key, 'ram' AS key, 'variant' AS owner, size || ' GB' AS value, CAST(size AS DOUBLE) AS number, 'GB' AS unit FROM k UNION ALL SELECT canonical_key, 'weight', 'product', size || ' g', NULL, NULL FROM k""")
def approved_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approved(spark, sf_dir)["attribute_values"].select("canonical_key", "key", "owner", "value", F.col("numeric_value").cast("double").alias("number"), "unit")


@query("approved_variants", f"SELECT canonical_key, count(*) AS variants, 1 AS defaults FROM (SELECT DISTINCT {_KEY} AS canonical_key, p_size FROM part) GROUP BY 1".replace("1 AS defaults", "CAST(1 AS BIGINT) AS defaults"))
def approved_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approved(spark, sf_dir)["variants"].groupBy("canonical_key").agg(F.count(F.lit(1)).alias("variants"), F.count_if("is_default").alias("defaults"))


@query("approved_sources", f"SELECT DISTINCT {_KEY} AS canonical_key, 'https://www.shop.example/' || replace(p_name, ' ', '-') AS url, 'shop.example' AS domain FROM part")
def approved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _approved(spark, sf_dir)["sources"].select("canonical_key", "url", "domain")


@query("good_drafts", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
def good_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_draft_id"), (F.col("l_quantity") * 150).alias("width"), F.lit(900).alias("height"))
    return M.good_drafts(_drafts(spark, sf_dir), media).select("id")


# ---- streams -----------------------------------------------------------------------------------


@query("stream_dedup_count", "SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY user_id")
def stream_dedup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = intake.once(intake.events_stream(spark, sf_dir), "event_id", "ts", "60 days")
    return intake.available_now(once, "stream_dedup", "append").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_source_stats", with_bound("SELECT domain, count(*) FILTER (WHERE outcome IN ('extracted', 'failed')) AS attempt_count, count(*) FILTER (WHERE outcome = 'extracted') AS extraction_success_count, count(*) FILTER (WHERE outcome = 'accepted') AS accepted_gallery_count, count(*) FILTER (WHERE outcome = 'failed') AS failure_count FROM attempts GROUP BY domain", "attempts"))
def stream_source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    attempts = intake.events_stream(spark, sf_dir).select(F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit(".shop.example")).alias("domain"), F.when(kind.isin("view", "click"), "extracted").when(kind == "purchase", "accepted").when(kind == "error", "failed").otherwise("none").alias("outcome"))
    return intake.available_now(intake.source_counters(attempts), "stream_stats", "complete")


@query("stream_windowed_events", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def stream_windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intake.available_now(intake.windowed(intake.events_stream(spark, sf_dir)), "stream_windows", "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 6).alias("total"))


@query("stream_sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intake.available_now(intake.sessions(intake.events_stream(spark, sf_dir), "user_id", "ts", "12 hours"), "stream_sessions", "complete")
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_failure_states", with_bound("""
    , c AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS changed FROM failures WINDOW w AS (PARTITION BY domain ORDER BY "at", id)), i AS (SELECT *, sum(changed) OVER (PARTITION BY domain ORDER BY "at", id) AS island FROM c)
    SELECT id, domain, kind, row_number() OVER (PARTITION BY domain, island ORDER BY "at", id) AS failure_count FROM i WHERE kind IS NOT NULL""", "failures"))
def stream_failure_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine over a stream; the batch query failure_streaks gives the same rows."""
    kind = F.col("event_type")
    rows = intake.events_stream(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain"), F.col("ts").alias("at"), F.when(kind == "error", "browser_timeout").when(kind == "click", "recipe_mismatch").when(kind == "signup", "rate_limited").alias("kind"))
    return intake.available_now(state.failing_sources(rows), "stream_failures", "append").select("id", "domain", "kind", "failure_count")


@query("stream_executed_once", "SELECT user_id || '-' || event_type AS idempotency_key, min(event_id) AS id, count(*) AS n, count(*) - 1 AS repeated FROM events GROUP BY ALL")
def stream_executed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intake.events_stream(spark, sf_dir).select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("idempotency_key"), F.col("event_id").alias("id"), F.lit("done").alias("result"))
    done = intake.available_now(state.executed_once(rows), "stream_once", "append")
    return done.groupBy("idempotency_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.count_if("repeated").alias("repeated"))


@query("stream_pushed_updates", """SELECT CASE kind WHEN 'voice' THEN 'voice' ELSE 'assistant' END AS queue, kind, count(*) AS n, sum(length(text)) AS chars, count(DISTINCT chat_id) AS chats
    FROM (SELECT DISTINCT conv_id * 1000 + turn AS update_id, CAST(conv_id AS VARCHAR) AS chat_id, CASE WHEN turn % 5 = 3 THEN 'voice' WHEN turn % 5 = 4 THEN 'callback' ELSE 'text' END AS kind, CASE WHEN turn % 5 = 3 THEN NULL ELSE text END AS text FROM conversations) GROUP BY kind""")
def stream_pushed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pushed updates (texts, voice messages, pressed buttons), each delivered twice, read from a drop folder and routed to queues."""
    folder = shared_dir(spark)
    turn, chat = F.col("turn") % 5, F.struct(F.col("conv_id").alias("id"))
    voice = F.when(turn == 3, F.struct(F.lit("file").alias("file_id")))
    message = F.struct(chat.alias("from"), chat.alias("chat"), F.col("turn").alias("message_id"), F.when(turn != 3, F.col("text")).alias("text"), voice.alias("voice"), F.lit(1_700_000_000).alias("date"))
    pressed = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), chat.alias("from"), F.struct(chat.alias("chat"), F.col("turn").alias("message_id"), F.lit(1_700_000_000).alias("date")).alias("message"), F.col("text").alias("data"))
    update = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("update_id"), F.when(turn != 4, message).alias("message"), F.when(turn == 4, pressed).alias("callback_query"))
    rows = table(spark, sf_dir, "conversations").select(F.to_json(update).alias("value"))
    rows.unionAll(rows).unionAll(spark.createDataFrame([("no update",), ("{}",)], "value string")).write.text(folder)
    updates = intake.available_now(intake.routed(intake.once(readers.pushed_updates(spark, folder))), "stream_updates", "append")
    return updates.groupBy("queue", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("chat_id").alias("chats"))
