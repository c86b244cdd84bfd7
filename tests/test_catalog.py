"""Catalogue, search and usage on small hand-made frames."""

from pyspark.sql import functions as F

from vitrine.operators import catalog as C
from vitrine.operators import search as S
from vitrine.operators import usage as A
from vitrine.schemas import frame, seed_categories


def shop(spark):
    brands = frame(spark, "brands", dict(id=1, name="Lenovo", slug="lenovo", country="CN", is_active=True), dict(id=2, name="ASUS", slug="asus", country="TW", is_active=False))
    categories = frame(spark, "categories", dict(id=1, name="Laptops", slug="laptops", is_active=True), dict(id=2, name="Computers", slug="computers", is_active=True))
    base = dict(status="published", is_active=True)
    products = frame(
        spark, "products", dict(id=1, title="Legion 5", brand_id=1, category_id=1, product_type="laptop", slug="legion-5", **base),
        dict(id=2, title="ROG NUC", brand_id=2, category_id=2, product_type="desktop", slug="rog-nuc", **base),
        dict(id=3, title="Hidden", brand_id=1, category_id=1, product_type="laptop", slug="hidden", status="published", is_active=False),
        dict(id=4, title="Only inactive variants", brand_id=1, category_id=1, product_type="laptop", slug="gone", **base))
    variants = frame(
        spark, "variants", dict(id=11, product_id=1, sku="L-1", color="red", price=None, is_active=True, is_default=True), dict(id=12, product_id=1, sku="L-2", color="blue", is_active=True),
        dict(id=21, product_id=2, sku="N-1", color="red", is_active=True), dict(id=31, product_id=3, sku="H-1", color="red", is_active=True), dict(id=41, product_id=4, sku="G-1", color="red", is_active=False))
    prices = {11: 1000, 12: 10, 21: 500, 31: 5, 41: 1}
    variants = variants.withColumn("price", F.element_at(F.create_map(*[F.lit(x) for p in prices.items() for x in p]), F.col("id").cast("int")).cast("decimal(12,2)"))
    definitions = frame(spark, "attribute_definitions", dict(id=1, key="cpu", label="CPU", is_filterable=True), dict(id=2, key="ram", label="Memory", is_filterable=True))
    values = frame(spark, "attribute_values", dict(id=1, attribute_definition_id=1, product_variant_id=11, value="AMD Ryzen 7", normalized_value="amd ryzen 7"), dict(id=2, attribute_definition_id=2, product_variant_id=11, value="8 GB"), dict(id=3, attribute_definition_id=2, product_variant_id=21, value="32 GB"))
    values = values.withColumn("numeric_value", F.regexp_extract("value", r"^(\d+)", 1).try_cast("decimal(14,4)"))
    return products, brands, categories, variants, values, definitions


def ids(rows):
    return sorted(r["id"] for r in rows.collect())


def test_visibility_and_slug(spark):
    products = shop(spark)[0]
    assert ids(products.where(C.visible())) == [1, 2, 4]
    assert ids(C.by_slug(products, "hidden")) == []


def test_combined_filters(spark):
    q = C.CatalogQuery(category="laptops", brand="lenovo", attributes={"cpu": ["AMD Ryzen 7"]})
    assert ids(C.filtered(*shop(spark), q)) == [1]


def test_zero_minimum_asks_for_an_active_variant_only(spark):
    assert ids(C.filtered(*shop(spark), C.CatalogQuery(price_min=0))) == [1, 2]
    assert ids(C.filtered(*shop(spark), C.CatalogQuery())) == [1, 2, 4]


def test_same_variant_differs_from_any_variant(spark):
    assert ids(C.filtered(*shop(spark), C.CatalogQuery(color="red", price_max=100))) == []
    assert ids(S.found(spark, *shop(spark), S.SearchQuery(color="red", price_max=100, active_only=True))) == [1, 4]


def test_ram_in_a_sentence_and_hidden_products(spark):
    assert ids(S.found(spark, *shop(spark), S.SearchQuery("найди ноутбук с 8 GB RAM"))) == [1]
    assert ids(S.found(spark, *shop(spark), S.SearchQuery("hidden"))) == [3]


def test_wildcards_are_literal(spark):
    assert ids(C.filtered(*shop(spark), C.CatalogQuery(search="%"))) == []
    assert ids(C.filtered(*shop(spark), C.CatalogQuery(search="l-2"))) == [1]


def test_prices_missing_come_last_either_way(spark):
    products, _, _, variants, *_ = shop(spark)
    for sort, first in (("price_asc", 3), ("price_desc", 1)):
        assert [r["id"] for r in C.ordered(products, variants, sort).collect()][-1] == 4
        assert C.ordered(products, variants, sort).first()["id"] == first


def test_facets_need_an_active_brand(spark):
    found = {(r["facet"], r["label"]): r["count"] for r in C.facets(*shop(spark)).collect()}
    assert found["brand", "Lenovo"] == 2 and ("brand", "ASUS") not in found
    assert found["country", "TW"] == 1 and found["color", "red"] == 2 and found["attribute:cpu", "AMD Ryzen 7"] == 1


def test_parameters(spark):
    q = C.CatalogQuery(color="red", price_min=0)
    assert q.echo()["color"] == ["red"] and q.parameters() == {"color": ["red"], "price_min": 0, "sort": "newest"}
    assert C.clamped_limit(99, 5, 10) == 10 and C.clamped_limit(None, 5, 10) == 5 and C.clamped_limit(-3, 5, 10) == 1
    try:
        C.CatalogQuery(per_page=51)
    except ValueError:
        pass
    else:
        raise AssertionError


def test_seed_rows_and_fallback(spark):
    seeds = seed_categories(spark)
    assert seeds.count() == 4
    assert C.or_fallback(seeds.where("false"), seeds).count() == 4 and C.or_fallback(seeds.where("id = 1"), seeds).count() == 1


def test_usage_golden_values(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    usage = lambda **k: __import__("json").dumps(k)
    runs = frame(
        spark, "ai_runs", dict(id=1, telegram_update_id=1, provider="openai", model="a", status="completed", usage=usage(prompt_tokens=1_000_000, completion_tokens=1_000_000), created_at=at),
        dict(id=2, telegram_update_id=2, provider="openai", model="b", status="completed", usage=usage(prompt_tokens=149, completion_tokens=129, cache_read_input_tokens=2432, reasoning_tokens=64), created_at=at),
        dict(id=3, telegram_update_id=2, provider="openai", model="none", status="failed", created_at=at))
    prices = frame(spark, "ai_models", *[dict(provider="openai", model=m) for m in "ab"]).withColumns({
        "input_per_million": F.when(F.col("model") == "a", F.lit("2.50")).otherwise(F.lit("0.15")).cast("decimal(12,6)"), "cached_input_per_million": F.lit("0.075").cast("decimal(12,6)"),
        "output_per_million": F.when(F.col("model") == "a", F.lit("15")).otherwise(F.lit("0.6")).cast("decimal(12,6)")})
    rows = {r["model"]: r for r in A.by_model(runs, prices).collect()}
    assert rows["a"]["cost"] == 17.5 and rows["none"]["cost"] is None
    b = rows["b"]
    assert (b["input"], b["cached_input"], b["output"], b["reasoning"], b["total"]) == (149, 2432, 129, 64, 2710)
    since = spark.createDataFrame([(2, at)], "telegram_update_id long, since timestamp")
    one = A.per_update(runs, since).first()
    assert (one["runs"], one["total"], one["unknown_failures"]) == (1, 2710, 1)
