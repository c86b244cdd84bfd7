"""Catalogue operators: visibility, faceted filters, ordering, paging, facets, cards and details.

Frames have the columns of ``vitrine.schemas.TABLES``; the test queries bind other tables to them
with ``select``. Joins are written once over already filtered inputs, so Catalyst prunes columns,
pushes filters to the scans and picks the physical join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import contains_ci
from vitrine.functions.urls import media_url
from vitrine.schemas import VOCABULARIES

SORTS = ("newest", "price_asc", "price_desc", "title")


@dataclass(frozen=True)
class CatalogQuery:
    """Parameters of a catalogue page. None is "not given"; 0 and "" are given but set no bound."""

    search: str | None = None
    category: str | None = None
    brand: str | None = None
    country: str | None = None
    product_type: list[str] = field(default_factory=list)
    color: str | list[str] | None = None
    stock_status: str | list[str] | None = None
    price_min: float | None = None
    price_max: float | None = None
    attributes: dict[str, list[str]] = field(default_factory=dict)
    sort: str = "newest"
    page: int = 1
    per_page: int = 12

    def __post_init__(self) -> None:
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {SORTS}")
        if not 1 <= self.per_page <= 50 or self.page < 1:
            raise ValueError("page starts at 1 and per_page lies between 1 and 50")
        if any(x is not None and x < 0 for x in (self.price_min, self.price_max)):
            raise ValueError("prices are not negative")

    def echo(self) -> dict:
        """The filters as the page shows them: lists where one value may be given, defaults filled in."""
        many = lambda v: list(v) if isinstance(v, (list, tuple)) else [v] if v else []
        return {
            "search": self.search or "", "category": self.category or "", "brand": self.brand or "", "country": self.country or "", "product_type": many(self.product_type),
            "color": many(self.color), "stock_status": many(self.stock_status), "price_min": self.price_min, "price_max": self.price_max,
            "attributes": {k: many(v) for k, v in self.attributes.items()}, "sort": self.sort,
        }

    def parameters(self) -> dict:
        """What a link to the page carries: only parameters that hold something."""
        return {k: v for k, v in self.echo().items() if v not in ("", None, [], {})}


def present(value: object) -> bool:
    return value is not None and value != [] and value != {}


def all_of(predicates: list[Column]) -> Column:
    """The conjunction of the predicates that were built; true for none."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


# ---- predicates --------------------------------------------------------------------------------


def visible(status: str = "status", active: str = "is_active") -> Column:
    return (F.col(status) == "published") & F.col(active)


def active_variants(variants: DataFrame) -> DataFrame:
    return variants.where("is_active")


def in_values(c: Column, values: str | list[str]) -> Column:
    return c.isin(list(values) if isinstance(values, (list, tuple)) else [values])


def searchable(column_names: list[str], term: str) -> Column:
    """Case-insensitive literal search over chosen columns of a grid."""
    return reduce(lambda a, b: a | b, (F.coalesce(contains_ci(F.col(c), F.lit(term)), F.lit(False)) for c in column_names))


def below_minimum(width: Column, height: Column, side: int) -> Column:
    """Width or height under the minimum; a missing side is not under it."""
    return F.coalesce(width < side, F.lit(False)) | F.coalesce(height < side, F.lit(False))


def allowed(identity: Column, stored: str | None, configured: str | None) -> Column:
    """Whether an id is on the allow-list: the stored list before the configured one; an empty list allows nobody."""
    names = [x.strip() for x in (stored or configured or "").replace("\n", ",").split(",") if x.strip()]
    return F.coalesce(identity.isin(names), F.lit(False)) if names else F.lit(False)


# ---- filters -----------------------------------------------------------------------------------


def matching_any_field(products: DataFrame, brands: DataFrame, variants: DataFrame, values: DataFrame, term: str) -> DataFrame:
    """Products with the term in title, model, description, brand name, or in sku, mpn, gtin or an attribute of any variant.

    The variants that match are one semi-joined set of product ids; the brand is a small left join.
    """
    t = F.lit(term)
    by_value = values.where(contains_ci(F.col("value"), t)).select(F.col("product_variant_id").alias("id")).where("id IS NOT NULL").distinct()
    by_code = variants.where(reduce(lambda a, b: a | b, (F.coalesce(contains_ci(F.col(c), t), F.lit(False)) for c in ("sku", "mpn", "gtin")))).select("product_id")
    owners = by_code.unionByName(variants.join(by_value, "id", "left_semi").select("product_id")).distinct().withColumnRenamed("product_id", "__hit")
    named = products.join(brands.select(F.col("id").alias("__brand"), F.col("name").alias("__brand_name")), F.col("brand_id") == F.col("__brand"), "left")
    joined = named.join(owners, F.col("id") == F.col("__hit"), "left")
    own = reduce(lambda a, b: a | b, (F.coalesce(contains_ci(F.col(c), t), F.lit(False)) for c in ("title", "model", "description", "__brand_name")))
    return joined.where(own | F.col("__hit").isNotNull()).select(*products.columns)


def same_variant(products: DataFrame, variants: DataFrame, values: DataFrame | None, definitions: DataFrame | None, q: CatalogQuery) -> DataFrame:
    """Products with one active variant that meets colour, stock, price and every attribute at once.

    Presence of a parameter asks for an active variant; only a value other than 0 or "" sets a bound.
    """
    if not any(map(present, (q.color, q.stock_status, q.price_min, q.price_max, q.attributes))):
        return products
    bounds = []
    if q.color:
        bounds.append(in_values(F.col("color"), q.color))
    if q.stock_status:
        bounds.append(in_values(F.col("stock_status"), q.stock_status))
    if q.price_min:
        bounds.append(F.col("price") >= q.price_min)
    if q.price_max:
        bounds.append(F.col("price") <= q.price_max)
    good = active_variants(variants).where(all_of(bounds))
    for key, wanted in q.attributes.items():
        if wanted:
            holders = values.where(in_values(F.col("value"), wanted)).join(definitions.where((F.col("key") == key) & F.col("is_filterable")).select(F.col("id").alias("attribute_definition_id")), "attribute_definition_id", "left_semi")
            good = good.join(holders.select(F.col("product_variant_id").alias("id")), "id", "left_semi")
    return products.join(good.select(F.col("product_id").alias("id")), "id", "left_semi")


def filtered(products: DataFrame, brands: DataFrame, categories: DataFrame, variants: DataFrame, values: DataFrame, definitions: DataFrame, q: CatalogQuery) -> DataFrame:
    """Visible products under all filters of a page."""
    out = products.where(visible())
    if q.search:
        out = matching_any_field(out, brands, variants, values, q.search)
    if q.category:
        out = out.join(categories.where(F.col("slug") == q.category).select(F.col("id").alias("category_id")), "category_id", "left_semi")
    if q.brand:
        out = out.join(brands.where(F.col("slug") == q.brand).select(F.col("id").alias("brand_id")), "brand_id", "left_semi")
    if q.country:
        out = out.join(brands.where(F.col("country") == q.country).select(F.col("id").alias("brand_id")), "brand_id", "left_semi")
    if q.product_type:
        out = out.where(in_values(F.col("product_type"), q.product_type))
    return same_variant(out.select(*products.columns), variants, values, definitions, q).select(*products.columns)


# ---- order and pages ---------------------------------------------------------------------------


def price_bounds(variants: DataFrame) -> DataFrame:
    """Lowest and highest price of the active variants of each product."""
    return active_variants(variants).groupBy("product_id").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def ordered(products: DataFrame, variants: DataFrame, sort: str) -> DataFrame:
    """Products in page order; a missing price comes last either way and ids settle ties."""
    if sort in ("price_asc", "price_desc"):
        prices = price_bounds(variants).withColumnRenamed("product_id", "id")
        joined = products.join(prices, "id", "left")
        key = F.col("min_price").asc_nulls_last() if sort == "price_asc" else F.col("max_price").desc_nulls_last()
        return joined.orderBy(key, "id")
    if sort == "title":
        return products.orderBy(F.col("title").asc_nulls_last(), "id")
    return products.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc())


def page_of(rows: DataFrame, page: int, per_page: int) -> DataFrame:
    """One page of ordered rows; Spark keeps the first ``page * per_page`` rows of each task."""
    return rows.offset((page - 1) * per_page).limit(per_page)


def clamped_limit(n: int | None, default: int, most: int) -> int:
    return min(max(default if n is None else n, 1), most)


def latest(rows: DataFrame, n: int | None, default: int = 10, most: int = 20, key: str = "id") -> DataFrame:
    return rows.orderBy(F.col(key).desc()).limit(clamped_limit(n, default, most))


def pending_of_latest(drafts: DataFrame, n: int = 10) -> DataFrame:
    """Those still pending among the latest ``n`` drafts of any status: the limit comes before the filter."""
    return drafts.orderBy(F.col("id").desc()).limit(n).where(F.col("status") == "pending_review")


# ---- one row per product -----------------------------------------------------------------------


def first_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def default_variants(variants: DataFrame) -> DataFrame:
    return first_per(active_variants(variants), ["product_id"], F.col("is_default").desc_nulls_last(), F.col("id"))


def primary_media(media: DataFrame) -> DataFrame:
    shown = media.where(F.col("verification_status").isin(VOCABULARIES["displayable"]))
    return first_per(shown, ["product_id"], F.col("is_primary").desc_nulls_last(), F.col("sort_order"), F.col("id"))


def translations_map(translations: DataFrame) -> DataFrame:
    """(category_id, labels): a map of locale to name, the last one of a locale counting."""
    last = first_per(translations.withColumn("__pos", F.monotonically_increasing_id()), ["category_id", "locale"], F.col("__pos").desc())
    return last.groupBy("category_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("locale", "name")))).alias("labels"))


def localized(labels: Column, locale: str, name: Column, label: Column, default: str) -> Column:
    """Translation, name, label or the default, whichever comes first."""
    return F.coalesce(F.try_element_at(labels, F.lit(locale)), name, label, F.lit(default))


def label_of(value: Column, labels: dict[str, str]) -> Column:
    """The label of a value, or the value itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), value), value)


def cards(products: DataFrame, brands: DataFrame, categories: DataFrame, translations: DataFrame, variants: DataFrame, media: DataFrame) -> DataFrame:
    """The card of each product: default variant, picture, brand and category, with fallbacks."""
    v = default_variants(variants).select(F.col("product_id").alias("id"), F.col("price").cast("double").alias("price"), F.coalesce(F.nullif("currency", F.lit("")), F.lit("CZK")).alias("currency"), F.coalesce(F.nullif("stock_status", F.lit("")), F.lit("unknown")).alias("stock_status"), "color")
    m = primary_media(media).select(F.col("product_id").alias("id"), media_url(F.col("disk"), F.col("path"), F.col("url")).alias("image"))
    b = brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand"), "country")
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"), F.col("slug").alias("category_slug")).join(translations_map(translations), "category_id", "left")
    out = products.join(v, "id", "left").join(m, "id", "left").join(b, "brand_id", "left").join(c, "category_id", "left")
    return out.select("id", "slug", "title", "model", "product_type", "brand", "country", "category", "category_slug", "labels", "price", F.coalesce("currency", F.lit("CZK")).alias("currency"), F.coalesce("stock_status", F.lit("unknown")).alias("stock_status"), "color", "image")


def merged_attributes(values: DataFrame, keys: list[str], key: str, order: str) -> DataFrame:
    """One row per key of an owner: the last one's value at the first one's place."""
    w = Window.partitionBy(*keys, key)
    ranked = values.withColumn("__n", F.row_number().over(w.orderBy(F.col(order).desc()))).withColumn("position", F.min(order).over(w))
    return ranked.where("__n = 1").drop("__n")


def details(products: DataFrame, variants: DataFrame, values: DataFrame, definitions: DataFrame, media: DataFrame, sources: DataFrame) -> DataFrame:
    """Each product with nested, ordered lists of variants, attributes, pictures and sources."""
    listed = lambda rows, owner, order, *cols: rows.groupBy(F.col(owner).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*cols).alias("item")))), lambda x: x["item"]).alias("items"))
    v = listed(active_variants(variants).withColumn("__d", -F.col("is_default").cast("int")), "product_id", ["__d", "id"], "id", "name", "sku", "color", "price", "currency", "stock_status").withColumnRenamed("items", "variants")
    a = values.where("product_id IS NOT NULL").join(definitions.select(F.col("id").alias("attribute_definition_id"), "key", "label", F.col("sort_order").alias("__o")), "attribute_definition_id")
    a = listed(a.withColumnRenamed("id", "__i"), "product_id", ["__o", "__i"], "key", "label", "value", "unit").withColumnRenamed("items", "attributes")
    m = listed(media.where(F.col("verification_status").isin(VOCABULARIES["displayable"])).withColumn("__p", -F.col("is_primary").cast("int")).withColumn("address", media_url(F.col("disk"), F.col("path"), F.col("url"))), "product_id", ["__p", "sort_order", "id"], F.col("address").alias("url"), "role", "width", "height").withColumnRenamed("items", "images")
    s = listed(sources.withColumnRenamed("id", "__i"), "product_id", ["__i"], "title", "url", "source_type").withColumnRenamed("items", "sources")
    return products.join(v, "id", "left").join(a, "id", "left").join(m, "id", "left").join(s, "id", "left")


def by_slug(products: DataFrame, slug: str) -> DataFrame:
    """The visible product of a slug; none if it is hidden."""
    return products.where(visible() & (F.col("slug") == slug))


def by_id(rows: DataFrame, key: int, column: str = "id") -> DataFrame:
    return rows.where(F.col(column) == key).limit(1)


def setting(settings: DataFrame, key: str, fallback: str) -> DataFrame:
    """One row: the value of a key or the fallback."""
    return settings.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(fallback)).alias("value"))


def or_fallback(rows: DataFrame, fallback: DataFrame) -> DataFrame:
    """``rows``, or all of ``fallback`` while there are none."""
    filled = rows.limit(1).select(F.lit(1).alias("__any"))
    return rows.unionByName(fallback.join(filled, F.lit(True), "left_anti"))


# ---- trees and bridges -------------------------------------------------------------------------


def with_parent(nodes: DataFrame, name: str = "name") -> DataFrame:
    """Each node of an adjacency list with its parent's name; roots have none."""
    p = nodes.select(F.col("id").alias("parent_id"), F.col(name).alias("parent_name"))
    return nodes.join(p, "parent_id", "left")


def tree_depths(spark, nodes: DataFrame) -> DataFrame:
    """(id, depth, path) of every node below a root, by a recursive query."""
    return spark.sql("""
        WITH RECURSIVE tree(id, depth, path) AS (
          SELECT id, 0, name FROM {nodes} WHERE parent_id IS NULL
          UNION ALL SELECT n.id, t.depth + 1, concat(t.path, ' / ', n.name) FROM {nodes} n JOIN tree t ON n.parent_id = t.id)
        SELECT id, depth, path FROM tree""", nodes=nodes)


def through_bridge(left: DataFrame, bridge: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Many-to-many: left rows with right rows through a table of pairs."""
    return bridge.join(left, left_key).join(right, right_key)


# ---- facets ------------------------------------------------------------------------------------


def count_facet(children: DataFrame, parents: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, count) of parents with at least one child."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return parents.join(counts, key).select(key, F.col(label).alias("label"), "count")


def distinct_facet(rows: DataFrame, owner: str, *keys: str) -> DataFrame:
    """Distinct owners of every value."""
    return rows.groupBy(*keys).agg(F.count_distinct(owner).alias("count"))


def facets(products: DataFrame, brands: DataFrame, categories: DataFrame, variants: DataFrame, values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(facet, key, label, count): all facets of the catalogue in one frame; they do not depend on the page's filters.

    Products are read once for their four facets, variants once for colours and prices and once more for attributes.
    """
    shown = products.where(visible())
    ids = shown.select(F.col("id").alias("product_id"))
    live = active_variants(variants).join(ids, "product_id", "left_semi")
    owned = shown.select("category_id", "brand_id", "product_type").join(categories.where("is_active").select(F.col("id").alias("category_id"), F.col("name").alias("category"), F.lit(True).alias("listed")), "category_id", "left").join(
        brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand"), F.nullif("country", F.lit("")).alias("country"), "is_active"), "brand_id", "left")
    entry = lambda name, key, label, there: F.when(there, F.struct(F.lit(name).alias("facet"), key.cast("string").alias("key"), label.cast("string").alias("label")))
    c = F.col
    entries = F.array(
        entry("category", c("category_id"), c("category"), c("listed")), entry("brand", c("brand_id"), c("brand"), c("is_active")), entry("country", c("country"), c("country"), c("country").isNotNull()),
        entry("type", c("product_type"), c("product_type"), F.lit(True)))
    of_products = owned.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).groupBy("e.facet", "e.key", "e.label").agg(F.count(F.lit(1)).alias("count"))
    by_color = live.groupBy("color", "product_id").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count(F.lit(1)).alias("n"))
    colors = by_color.groupBy("color").agg(F.count(F.lit(1)).alias("count"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    of_colors = colors.where("color <> ''").select(F.lit("color").alias("facet"), c("color").alias("key"), c("color").alias("label"), "count")
    of_prices = colors.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.sum("n"), F.lit(0)).alias("count")).select(F.lit("price").alias("facet"), c("low").cast("string").alias("key"), c("high").cast("string").alias("label"), "count")
    attribute = distinct_facet(values.join(live.select(F.col("id").alias("product_variant_id"), F.col("product_id").alias("__product")), "product_variant_id").join(definitions.where("is_filterable").select(F.col("id").alias("attribute_definition_id"), F.col("key").alias("attribute")), "attribute_definition_id"), "__product", "attribute", "value", "normalized_value")
    parts = [of_products, of_colors, of_prices, attribute.select(F.concat(F.lit("attribute:"), "attribute").alias("facet"), F.col("normalized_value").alias("key"), F.col("value").alias("label"), "count")]
    return reduce(DataFrame.unionByName, parts)


def grouped_facets(rows: DataFrame) -> DataFrame:
    """Facets as one row each with the list of their values, most frequent first."""
    return rows.groupBy("facet").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "label", "key"))), lambda x: F.struct(x["key"].alias("key"), x["label"].alias("label"), (-x["n"]).alias("count"))).alias("values"))


def status_report(products: DataFrame, drafts: DataFrame, runs: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """One row: totals, active, inactive, pending, failed of the last day, waiting jobs."""
    p = products.agg(F.count(F.lit(1)).alias("products"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"))
    d = drafts.agg(F.count_if(F.col("status") == "pending_review").alias("pending_drafts"))
    r = runs.agg(F.count_if((F.col("status") == "failed") & (F.col("created_at") >= now - F.expr("INTERVAL 1 DAY"))).alias("failed_runs_24h"))
    j = jobs.agg(F.count_if(F.col("reserved_at").isNull()).alias("waiting_jobs"))
    return p.join(d).join(r).join(j)  # one row each


def recent_errors(runs: DataFrame, jobs: DataFrame, n: int | None, sanitize) -> DataFrame:
    """The latest failed runs and failed jobs, tagged, with secrets out."""
    n = clamped_limit(n, 5, 10)
    a = runs.where("status = 'failed'").orderBy(F.col("id").desc()).limit(n).select(F.lit("run").alias("kind"), "id", sanitize(F.col("prompt")).alias("message"))
    b = jobs.orderBy(F.col("id").desc()).limit(n).select(F.lit("job").alias("kind"), "id", sanitize(F.col("exception")).alias("message"))
    return a.unionByName(b)
