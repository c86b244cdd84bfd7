"""Catalogue queries: pages, filters, facets, cards, details, trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import text as T
from vitrine.operators import catalog as C
from vitrine.operators import merge as M
from vitrine.operators import search as S
from vitrine.operators import text_index as I
from vitrine.operators import windows as W
from vitrine.plans.binding import bound, with_bound
from vitrine.registry import query
from vitrine.session import shared_dir, table

VISIBLE = "status = 'published' AND is_active"


def _all(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [bound(spark, sf_dir, n) for n in names]


def _page(sort: str, order: str, extra: str = "", page: int = 1):
    sql = with_bound(f"""
        SELECT p.id, p.title {extra} FROM products p LEFT JOIN (SELECT product_id, min(price) AS min_price, max(price) AS max_price FROM variants WHERE is_active GROUP BY 1) x ON x.product_id = p.id
        WHERE {VISIBLE} ORDER BY {order} LIMIT 12 OFFSET {(page - 1) * 12}""", "products", "variants")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        products, variants = _all(spark, sf_dir, "products", "variants")
        q = C.CatalogQuery(sort=sort, page=page)
        rows = C.page_of(C.ordered(products.where(C.visible()), variants, q.sort), q.page, q.per_page)
        return rows.select("id", "title", *[F.col(c).cast("double").alias(c) for c in ("min_price", "max_price") if c in extra])

    return sql, run


for _name, _args in {
    "catalog_listing_newest": ("newest", "p.published_at DESC NULLS LAST, p.id DESC"),
    "catalog_listing_price_asc": ("price_asc", "min_price ASC NULLS LAST, p.id", ", CAST(min_price AS DOUBLE) AS min_price"),
    "catalog_listing_price_desc": ("price_desc", "max_price DESC NULLS LAST, p.id", ", CAST(max_price AS DOUBLE) AS max_price"),
    "catalog_listing_title": ("title", "p.title NULLS LAST, p.id"),
    "catalog_page_3": ("newest", "p.published_at DESC NULLS LAST, p.id DESC", "", 3),
}.items():
    _sql, _run = _page(*_args)
    query(_name, _sql)(_run)


def _filter(q: C.CatalogQuery):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.filtered(*_all(spark, sf_dir, "products", "brands", "categories", "variants", "attribute_values", "attribute_definitions"), q).select("id")

    return run


_F = ("products", "brands", "categories", "variants", "attribute_values", "attribute_definitions")
query("catalog_filter_same_variant", with_bound(f"""
    SELECT id FROM products p WHERE {VISIBLE} AND EXISTS (SELECT 1 FROM variants v WHERE v.product_id = p.id AND v.is_active AND color = 'A' AND stock_status = 'in_stock' AND price >= 20000 AND price <= 40000)""", *_F))(
    _filter(C.CatalogQuery(color="A", stock_status="in_stock", price_min=20000, price_max=40000)))
query("catalog_filter_zero_min_price", with_bound(f"SELECT id FROM products p WHERE {VISIBLE} AND EXISTS (SELECT 1 FROM variants v WHERE v.product_id = p.id AND v.is_active)", *_F))(_filter(C.CatalogQuery(price_min=0)))
query("catalog_filter_attribute", with_bound(f"""
    SELECT id FROM products p WHERE {VISIBLE} AND EXISTS (SELECT 1 FROM variants v WHERE v.product_id = p.id AND v.is_active AND color = 'R' AND EXISTS (
        SELECT 1 FROM attribute_values a JOIN attribute_definitions d ON d.id = a.attribute_definition_id WHERE a.product_variant_id = v.id AND d.key = 'ram' AND a.value IN ('8 GB', '16 GB')))""", *_F))(
    _filter(C.CatalogQuery(color="R", attributes={"ram": ["8 GB", "16 GB"]})))
query("catalog_filter_dimensions", with_bound(f"""
    SELECT id FROM products p WHERE {VISIBLE} AND product_type IN (SELECT min(product_type) FROM products UNION SELECT max(product_type) FROM products)
      AND brand_id IN (SELECT id FROM brands WHERE country = 'FRANCE' OR country <> '') AND category_id IN (SELECT id FROM categories WHERE slug = 'asia')""", *_F))(
    lambda spark, sf_dir: _filter(C.CatalogQuery(category="asia", product_type=list(bound(spark, sf_dir, "products").agg(F.min("product_type"), F.max("product_type")).first())))(spark, sf_dir))
query("catalog_text_search", with_bound(f"""
    SELECT p.id FROM products p LEFT JOIN brands b ON b.id = p.brand_id WHERE {VISIBLE.replace('is_active', 'p.is_active')} AND (contains(lower(title), 'sku-10') OR contains(lower(model), 'sku-10') OR contains(lower(description), '#3') OR contains(lower(b.name), '#3')
      OR EXISTS (SELECT 1 FROM variants v WHERE v.product_id = p.id AND contains(lower(v.sku), '#3')) OR contains(lower(title), '#3') OR contains(lower(model), '#3'))""", *_F).replace("contains(lower(title), 'sku-10') OR contains(lower(model), 'sku-10') OR ", ""))(
    _filter(C.CatalogQuery(search="#3")))
query("catalog_code_search", with_bound(f"""
    SELECT p.id FROM products p WHERE {VISIBLE} AND (contains(lower(title), 'sku-12') OR EXISTS (SELECT 1 FROM variants v WHERE v.product_id = p.id AND contains(lower(v.sku), 'sku-12'))
      OR EXISTS (SELECT 1 FROM variants v JOIN attribute_values a ON a.product_variant_id = v.id WHERE v.product_id = p.id AND contains(lower(a.value), 'sku-12')))""", *_F))(_filter(C.CatalogQuery(search="SKU-12")))


_TERMS = ["#3", "SKU-12", "Ring", "ga", "r", "8 GB", "l b", "%", "no such thing", ""]
_LINES = """lines AS (SELECT id AS owner, unnest([title, model, description]) AS text FROM products UNION ALL SELECT p.id, b.name FROM products p JOIN brands b ON b.id = p.brand_id UNION ALL SELECT product_id, unnest([sku, mpn, gtin]) FROM variants
      UNION ALL SELECT v.product_id, a.value FROM attribute_values a JOIN variants v ON v.id = a.product_variant_id)"""


@query("search_indexed", with_bound(f""", {_LINES}
    SELECT DISTINCT term, owner AS id FROM lines JOIN (VALUES {", ".join(f"('{t}')" for t in _TERMS)}) t(term) ON contains(lower(text), lower(term))""", *_F))
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that the catalogue's search finds for terms of any length, by the gram index."""
    products, brands, _, variants, values, _ = _all(spark, sf_dir, *_F)
    index = I.TextIndex(spark, shared_dir(spark)).add(I.catalog_texts(products, brands, variants, values))
    found = [index.containing(t).select(F.lit(t).alias("term"), F.col("owner").alias("id")) for t in _TERMS]
    return reduce(DataFrame.unionByName, found)


_SENTENCES = {"ring sku-1": ["ring", "sku-1"], "Memory N 4": ["Memory", "N", "4"], "asia size": ["asia", "size"], "none at all": ["none", "at", "all"]}


@query("search_all_indexed", with_bound(f""", {_LINES}, every AS (SELECT * FROM lines UNION ALL SELECT p.id, c.name FROM products p JOIN categories c ON c.id = p.category_id UNION ALL SELECT product_id, unnest([name, color]) FROM variants
      UNION ALL SELECT v.product_id, unnest([d.key, d.label]) FROM attribute_values a JOIN attribute_definitions d ON d.id = a.attribute_definition_id JOIN variants v ON v.id = a.product_variant_id
      UNION ALL SELECT a.product_id, unnest([a.value, d.key, d.label]) FROM attribute_values a JOIN attribute_definitions d ON d.id = a.attribute_definition_id WHERE a.product_id IS NOT NULL),
    terms AS (SELECT query, unnest(terms) AS term, len(terms) AS n FROM (VALUES {", ".join(f"('{q}', {t})" for q, t in _SENTENCES.items())}) t(query, terms))
    SELECT query, owner AS id FROM (SELECT DISTINCT query, term, n, owner FROM every JOIN terms ON contains(lower(text), lower(term))) GROUP BY query, owner, n HAVING count(*) = n""", *_F))
def search_all_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that have every term of a query in one of the fields that the chat bot searches, by the gram index."""
    index = I.TextIndex(spark, shared_dir(spark)).add(I.chat_texts(*_all(spark, sf_dir, *_F)))
    return reduce(DataFrame.unionByName, [index.with_all(terms).select(F.lit(q).alias("query"), F.col("owner").alias("id")) for q, terms in _SENTENCES.items()])


@query("catalog_filter_any_variant", with_bound("""
    SELECT id FROM products p WHERE EXISTS (SELECT 1 FROM variants v WHERE v.product_id = p.id AND contains(lower(color), 'a')) AND EXISTS (SELECT 1 FROM variants v WHERE v.product_id = p.id AND price >= 40000)
      AND EXISTS (SELECT 1 FROM variants v JOIN attribute_values a ON a.product_variant_id = v.id WHERE v.product_id = p.id AND a.attribute_definition_id = 1 AND numeric_value >= 45) ORDER BY id DESC LIMIT 10""", *_F))
def any_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.found(spark, *_all(spark, sf_dir, *_F), S.SearchQuery(color="a", price_min=40000, ram_min=45, limit=50)).select("id")


@query("search_ram_sentence", with_bound("""
    SELECT id FROM products p WHERE EXISTS (SELECT 1 FROM variants v JOIN attribute_values a ON a.product_variant_id = v.id WHERE v.product_id = p.id AND a.attribute_definition_id = 1 AND numeric_value >= 8)
      AND EXISTS (SELECT 1 FROM variants v JOIN attribute_values a ON a.product_variant_id = v.id WHERE v.product_id = p.id AND a.attribute_definition_id = 1 AND numeric_value <= 8) ORDER BY id DESC LIMIT 5""", *_F))
def ram_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.SearchQuery("найди что-нибудь с 8 ГБ RAM", product_type="")
    return S.found(spark, *_all(spark, sf_dir, *_F), q).select("id")


@query("search_document_terms", with_bound(r"""
    SELECT p.id FROM products p JOIN brands b ON b.id = p.brand_id LEFT JOIN categories c ON c.id = p.category_id
    WHERE contains(lower(concat_ws(chr(10), title, model, description, b.name, c.name)), 'brand') AND contains(lower(concat_ws(chr(10), title, model, description, b.name, c.name)), 'asia') ORDER BY p.id DESC LIMIT 5""", *_F))
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.found(spark, *_all(spark, sf_dir, *_F), S.SearchQuery("find brand, asia")).select("id")


# ---- facets ------------------------------------------------------------------------------------

_FACETS = f"""
    , live AS (SELECT v.* FROM variants v JOIN products p ON p.id = v.product_id WHERE v.is_active AND p.status = 'published' AND p.is_active),
    parts AS (
    SELECT 'category' AS facet, CAST(c.id AS VARCHAR) AS key, c.name AS label, count(*) AS count FROM products p JOIN categories c ON c.id = p.category_id WHERE {VISIBLE.replace('is_active', 'p.is_active')} AND c.is_active GROUP BY c.id, c.name
    UNION ALL SELECT 'brand', CAST(b.id AS VARCHAR), b.name, count(*) FROM products p JOIN brands b ON b.id = p.brand_id WHERE {VISIBLE.replace('is_active', 'p.is_active')} AND b.is_active GROUP BY b.id, b.name
    UNION ALL SELECT 'country', b.country, b.country, count(DISTINCT p.id) FROM products p JOIN brands b ON b.id = p.brand_id WHERE {VISIBLE.replace('is_active', 'p.is_active')} GROUP BY b.country
    UNION ALL SELECT 'type', product_type, product_type, count(*) FROM products WHERE {VISIBLE} GROUP BY product_type
    UNION ALL SELECT 'color', color, color, count(DISTINCT product_id) FROM live WHERE color <> '' GROUP BY color
    UNION ALL SELECT 'attribute:' || d.key, a.normalized_value, a.value, count(DISTINCT l.product_id) FROM live l JOIN attribute_values a ON a.product_variant_id = l.id JOIN attribute_definitions d ON d.id = a.attribute_definition_id WHERE d.is_filterable GROUP BY d.key, a.normalized_value, a.value
    UNION ALL SELECT 'price', CAST(min(price) AS VARCHAR), CAST(max(price) AS VARCHAR), count(*) FROM live)"""


def _facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.facets(*_all(spark, sf_dir, *_F))


query("facets_all", with_bound(_FACETS + " SELECT facet, key, label, count FROM parts", *_F))(_facets)
for _name in ("category", "brand", "country", "type", "color", "price"):
    query(f"facet_{_name}" + ("_range" if _name == "price" else ""), with_bound(_FACETS + f" SELECT key, label, count FROM parts WHERE facet = '{_name}'", *_F))(
        lambda spark, sf_dir, n=_name: _facets(spark, sf_dir).where(F.col("facet") == n).select("key", "label", "count"))
query("facet_attribute", with_bound(_FACETS + " SELECT facet, key, label, count FROM parts WHERE facet LIKE 'attribute:%'", *_F))(
    lambda spark, sf_dir: _facets(spark, sf_dir).where(F.col("facet").startswith("attribute:")))
query("facets_grouped", with_bound(_FACETS + " SELECT facet, count(*) AS n, CAST(sum(count) AS BIGINT) AS total, max(count) AS top FROM parts GROUP BY facet", *_F))(
    lambda spark, sf_dir: C.grouped_facets(_facets(spark, sf_dir)).select("facet", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x["count"]).alias("total"), F.col("values")[0]["count"].alias("top")))


# ---- one row per product -----------------------------------------------------------------------


@query("default_variant", with_bound("SELECT product_id, id, CAST(price AS DOUBLE) AS price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY is_default DESC, id) AS n FROM variants WHERE is_active) WHERE n = 1", "variants"))
def default_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.default_variants(bound(spark, sf_dir, "variants")).select("product_id", "id", F.col("price").cast("double").alias("price"))


_MEDIA_URL = "CASE WHEN disk = 'public' THEN '/storage/' || path ELSE url END"


@query("primary_media", with_bound(f"SELECT product_id, id, {_MEDIA_URL} AS url FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY is_primary DESC, sort_order, id) AS n FROM media WHERE verification_status IN ('verified', 'manual')) WHERE n = 1", "media"))
def primary_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.functions.urls import media_url

    return C.primary_media(bound(spark, sf_dir, "media")).select("product_id", "id", media_url(F.col("disk"), F.col("path"), F.col("url")).alias("url"))


_CARDS = ("products", "brands", "categories", "category_translations", "variants", "media")


@query("catalog_cards", with_bound(f"""
    , v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY is_default DESC, id) AS n FROM variants WHERE is_active) WHERE n = 1),
    m AS (SELECT product_id, {_MEDIA_URL} AS image FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY is_primary DESC, sort_order, id) AS n FROM media WHERE verification_status IN ('verified', 'manual')) WHERE n = 1)
    SELECT p.id, p.title, b.name AS brand, b.country, c.name AS category, coalesce(t.name, c.name, 'other') AS category_cs, CAST(v.price AS DOUBLE) AS price, coalesce(nullif(v.currency, ''), 'CZK') AS currency,
           coalesce(nullif(v.stock_status, ''), 'unknown') AS stock_status, m.image
    FROM products p LEFT JOIN v ON v.product_id = p.id LEFT JOIN m ON m.product_id = p.id LEFT JOIN brands b ON b.id = p.brand_id LEFT JOIN categories c ON c.id = p.category_id
    LEFT JOIN category_translations t ON t.category_id = c.id AND t.locale = 'cs' WHERE p.status = 'published' AND p.is_active""", *_CARDS))
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _all(spark, sf_dir, *_CARDS)
    rows = C.cards(frames[0].where(C.visible()), *frames[1:])
    return rows.select("id", "title", "brand", "country", "category", C.localized(F.col("labels"), "cs", F.col("category"), F.lit(None).cast("string"), "other").alias("category_cs"), "price", "currency", "stock_status", "image")


@query("catalog_details", with_bound("""
    SELECT p.id, (SELECT count(*) FROM variants v WHERE v.product_id = p.id AND v.is_active) AS n_variants,
           (SELECT arg_min(v.id, (NOT v.is_default, v.id)) FROM variants v WHERE v.product_id = p.id AND v.is_active) AS first_variant,
           (SELECT a.value FROM attribute_values a WHERE a.product_id = p.id) AS size, (SELECT count(*) FROM media m WHERE m.product_id = p.id AND m.verification_status IN ('verified', 'manual')) AS n_images
    FROM products p WHERE p.status = 'published' AND p.is_active""", "products", "variants", "attribute_values", "media"))
def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, variants, values, definitions, media = _all(spark, sf_dir, "products", "variants", "attribute_values", "attribute_definitions", "media")
    sources = spark.createDataFrame([], "id long, product_id long, title string, url string, source_type string")
    rows = C.details(products.where(C.visible()), variants, values, definitions, media.withColumn("role", F.lit("detail")), sources)
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return rows.select("id", F.when(F.col("variants").isNull(), 0).otherwise(count("variants")).cast("long").alias("n_variants"), F.try_element_at("variants", F.lit(1))["id"].alias("first_variant"), F.try_element_at("attributes", F.lit(1))["value"].alias("size"), F.when(F.col("images").isNull(), 0).otherwise(count("images")).cast("long").alias("n_images"))


@query("attribute_merge_last_wins", """
    SELECT l_partkey, l_returnflag, l_quantity, position FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY ord DESC) AS n, min(ord) OVER (PARTITION BY l_partkey, l_returnflag) AS position
      FROM (SELECT *, l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey AS ord FROM lineitem)) WHERE n = 1""")
def attribute_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.expr("l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey"))
    return C.merged_attributes(rows, ["l_partkey"], "l_returnflag", "ord").select("l_partkey", "l_returnflag", "l_quantity", "position")


@query("product_by_slug", with_bound(f"SELECT id, title FROM products WHERE {VISIBLE} AND slug = (SELECT min(slug) FROM products)", "products"))
def product_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = bound(spark, sf_dir, "products")
    return C.by_slug(products, products.agg(F.min("slug")).first()[0]).select("id", "title")


@query("product_by_id", with_bound("SELECT id, title, status FROM products WHERE id = 42", "products"))
def product_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_id(bound(spark, sf_dir, "products"), 42).select("id", "title", "status")


@query("setting_fallback", "SELECT coalesce(max(r_name), 'none') AS value FROM region WHERE r_name = 'NOWHERE' UNION ALL SELECT coalesce(max(r_name), 'none') FROM region WHERE r_name = 'ASIA'")
def setting_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_name").alias("value"))
    return C.setting(settings, "NOWHERE", "none").unionByName(C.setting(settings, "ASIA", "none"))


@query("models_fallback", with_bound(" SELECT provider, model FROM ai_models", "ai_models"))
def models_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = bound(spark, sf_dir, "ai_models").select("provider", "model")
    return C.or_fallback(models.where("provider = 'nobody'"), models)


@query("exists_test", "SELECT count(*) > 0 AS found FROM part WHERE p_size < 2")
def exists_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size < 2").limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


# ---- trees, bridges, grids ---------------------------------------------------------------------


@query("category_tree", """SELECT CAST(r_regionkey AS BIGINT) AS id, 0 AS depth, r_name AS path FROM region UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), 1, r_name || ' / ' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey""")
def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tree_depths(spark, bound(spark, sf_dir, "categories"))


@query("category_parents", with_bound("SELECT c.id, c.name, p.name AS parent_name FROM categories c LEFT JOIN categories p ON p.id = c.parent_id", "categories"))
def category_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_parent(bound(spark, sf_dir, "categories")).select("id", "name", "parent_name")


@query("bridge_join", "SELECT s_suppkey, p_partkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size = 7 GROUP BY ALL")
def bridge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "part").where("p_size = 7").withColumnRenamed("p_partkey", "l_partkey")
    right = table(spark, sf_dir, "supplier").withColumn("l_suppkey", F.col("s_suppkey"))
    rows = C.through_bridge(left, table(spark, sf_dir, "lineitem"), right, "l_partkey", "l_suppkey")
    return rows.groupBy("s_suppkey", F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))


@query("translation_maps", with_bound("SELECT category_id, max(CASE WHEN locale = 'en' THEN name END) AS en, max(CASE WHEN locale = 'cs' THEN name END) AS cs FROM category_translations GROUP BY 1", "category_translations"))
def translation_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.translations_map(bound(spark, sf_dir, "category_translations"))
    return rows.select("category_id", F.try_element_at("labels", F.lit("en")).alias("en"), F.try_element_at("labels", F.lit("cs")).alias("cs"))


@query("grid_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_brand), '#2')")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    a, b = parts.where(C.searchable(["p_name"], "1")), parts.where(C.searchable(["p_brand"], "#2"))
    return a.unionByName(b).select("p_partkey").distinct()


@query("label_lookup", "SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'Eleven' WHEN 'Brand#12' THEN 'Twelve' ELSE p_brand END AS label FROM part")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.label_of(F.col("p_brand"), {"Brand#11": "Eleven", "Brand#12": "Twelve"}).alias("label"))


@query("plural_forms", "SELECT o_orderkey, CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 'one' WHEN n % 10 BETWEEN 2 AND 4 AND NOT n % 100 BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS uk, CASE WHEN n = 1 THEN 'one' WHEN n BETWEEN 2 AND 4 THEN 'few' ELSE 'many' END AS cs, CASE WHEN n = 1 THEN 'one' ELSE 'many' END AS en FROM (SELECT o_orderkey, o_custkey % 130 AS n FROM orders)")
def plural_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_custkey") % 130
    return table(spark, sf_dir, "orders").select("o_orderkey", *[T.plural_form(n, F.lit(x)).alias(x) for x in ("uk", "cs", "en")])


@query("pending_of_latest", "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10) WHERE o_orderstatus = 'P'")
def pending_of_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending_review").otherwise("approved").alias("status"))
    return C.pending_of_latest(drafts).select(F.col("id").alias("o_orderkey"))


@query("latest_clamped", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def latest_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest(table(spark, sf_dir, "orders"), 500, key="o_orderkey").select("o_orderkey")


@query("in_list_order", "SELECT pos, p_partkey, p_name FROM (SELECT unnest([7, 3, 99, 12]) AS k, unnest([0, 1, 2, 3]) AS pos) JOIN part ON p_partkey = k")
def in_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (7, 3, 99, 12)))).alias("pos", "p_partkey"))
    return table(spark, sf_dir, "part").join(wanted, "p_partkey").orderBy("pos").select("pos", "p_partkey", "p_name")


@query("json_documents", "SELECT p_partkey, '{\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}' AS document FROM part WHERE NOT contains(p_name, '\"')")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitrine.sources.sinks import json_document

    return table(spark, sf_dir, "part").where(~F.col("p_name").contains('"')).select("p_partkey", json_document("p_name", "p_size").alias("document"))


@query("status_report", with_bound("""
    SELECT (SELECT count(*) FROM products) AS products, (SELECT count(*) FROM products WHERE is_active) AS active, (SELECT count(*) FROM products WHERE NOT is_active) AS inactive, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending_drafts,
           (SELECT count(*) FROM ai_runs WHERE status = 'failed' AND created_at >= (SELECT max(created_at) FROM ai_runs) - INTERVAL 1 DAY) AS failed_runs_24h, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS waiting_jobs""", "products", "ai_runs"))
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = bound(spark, sf_dir, "ai_runs")
    now = runs.agg(F.max("created_at")).first()[0]
    drafts = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "P", "pending_review").alias("status"))
    jobs = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") >= 0, 1).alias("reserved_at"))
    return C.status_report(bound(spark, sf_dir, "products"), drafts, runs, jobs, F.lit(now).cast("timestamp_ntz"))


@query("recent_errors", with_bound("SELECT 'run' AS kind, id, prompt AS message FROM (SELECT * FROM ai_runs WHERE status = 'failed' ORDER BY id DESC LIMIT 5) UNION ALL SELECT 'job', o_orderkey, o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5)", "ai_runs"))
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("exception"))
    return C.recent_errors(bound(spark, sf_dir, "ai_runs"), jobs, None, T.redact)


@query("allow_list", "SELECT c_custkey, c_custkey IN (1, 5, 9) AS stored, false AS nobody FROM customer")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", C.allowed(who, "1, 5\n9", "2").alias("stored"), C.allowed(who, "", None).alias("nobody"))


@query("below_minimum", with_bound("SELECT id, width < 450 OR height < 450 AS small FROM media", "media"))
def below_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "media").select("id", C.below_minimum(F.col("width"), F.col("height"), 450).alias("small"))


@query("anti_definitions", with_bound("SELECT id, key FROM attribute_definitions d WHERE key NOT IN ('cpu') AND NOT EXISTS (SELECT 1 FROM attribute_values a WHERE a.attribute_definition_id = d.id)", "attribute_definitions", "attribute_values"))
def anti_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.orphan_definitions(*_all(spark, sf_dir, "attribute_definitions", "attribute_values"), ["cpu"]).select("id", "key")


@query("last_n_messages", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def last_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.last_n(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 4).select("conv_id", "turn", "role")


@query("latest_per_key", with_bound("SELECT telegram_update_id, max(id) AS id, arg_max(model, id) AS model FROM ai_runs GROUP BY 1", "ai_runs"))
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest_per(bound(spark, sf_dir, "ai_runs"), ["telegram_update_id"]).select("telegram_update_id", "id", "model")
