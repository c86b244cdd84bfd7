"""The free-text and structured product search of the chat bot.

Unlike the catalogue page it looks at hidden products and inactive variants, and each structured
filter may be met by another variant. Free text is matched against one search document per product,
built by aggregation once, instead of eight existence joins per term.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text as T
from vitrine.operators.catalog import clamped_limit, visible


@dataclass(frozen=True)
class SearchQuery:
    query: str = ""
    brand: str = ""
    cpu: str = ""
    gpu: str = ""
    color: str = ""
    product_type: str | None = None
    ram_min: float | None = None
    ram_max: float | None = None
    price_min: float | None = None
    price_max: float | None = None
    active_only: bool = False
    limit: int | None = None


def search_documents(products: DataFrame, brands: DataFrame, categories: DataFrame, variants: DataFrame, values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, document): all searchable fields of a product, lower-cased, a line each."""
    named = values.join(definitions.select(F.col("id").alias("attribute_definition_id"), "key", "label"), "attribute_definition_id", "left").withColumn("line", F.concat_ws("\n", "value", "key", "label"))
    by_variant = named.where("product_variant_id IS NOT NULL").join(variants.select(F.col("id").alias("product_variant_id"), F.col("product_id").alias("owner")), "product_variant_id").select("owner", "line")
    by_product = named.where("product_id IS NOT NULL").select(F.col("product_id").alias("owner"), "line")
    codes = variants.select(F.col("product_id").alias("owner"), F.concat_ws("\n", "sku", "mpn", "gtin", "name", "color").alias("line"))
    lines = by_variant.unionByName(by_product).unionByName(codes).groupBy("owner").agg(F.array_join(F.collect_list("line"), "\n").alias("lines"))
    b = brands.select(F.col("id").alias("brand_id"), F.col("name").alias("__brand"))
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("__category"))
    out = products.join(b, "brand_id", "left").join(c, "category_id", "left").join(lines, F.col("id") == F.col("owner"), "left")
    return out.select("id", F.lower(F.concat_ws("\n", "title", "model", "description", "__brand", "__category", "lines")).alias("document"))


def _meeting_all(products: DataFrame, rows: DataFrame, conditions: list[Column]) -> DataFrame:
    """Products that for each condition have one of ``rows`` (owner, ...) that meets it, not the same one for all: one pass over the rows."""
    if not conditions:
        return products
    flags = [F.max(F.coalesce(c, F.lit(False))).alias(f"__f{i}") for i, c in enumerate(conditions)]
    owners = rows.where(reduce(lambda a, b: a | b, conditions)).groupBy("owner").agg(*flags).where(reduce(lambda a, b: a & b, [F.col(f"__f{i}") for i in range(len(conditions))]))
    return products.join(owners.select(F.col("owner").alias("id")), "id", "left_semi")


def _attribute_rows(variants: DataFrame, values: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """(owner, key, value, numeric_value): the values of some attributes, of products and of their variants."""
    own = values.join(definitions.where(F.col("key").isin(keys)).select(F.col("id").alias("attribute_definition_id"), "key"), "attribute_definition_id")
    by_variant = own.join(variants.select(F.col("id").alias("product_variant_id"), F.col("product_id").alias("owner")), "product_variant_id")
    columns = ["owner", "key", "value", "numeric_value"]
    return own.where("product_id IS NOT NULL").withColumnRenamed("product_id", "owner").select(*columns).unionByName(by_variant.select(*columns))


def found(spark, products: DataFrame, brands: DataFrame, categories: DataFrame, variants: DataFrame, values: DataFrame, definitions: DataFrame, q: SearchQuery) -> DataFrame:
    """Products of a search, latest first. Structured filters switch the free text off."""
    named = spark.range(1).select(T.ram_gb(F.lit(q.query)).alias("ram"), T.search_terms(F.lit(q.query)).alias("terms"), T.infer_product_type(F.lit(q.query)).alias("type")).first()  # one row from a parameter
    ram_min, ram_max = (q.ram_min, q.ram_max) if q.ram_min is not None or named["ram"] is None else (named["ram"], named["ram"])
    kind = q.product_type if q.product_type is not None else named["type"]
    specific = bool(q.brand or q.cpu or q.gpu or q.color) or any(x is not None for x in (ram_min, ram_max, q.price_min, q.price_max))
    out = products.where(visible()) if q.active_only else products
    if kind:
        out = out.where(F.col("product_type") == kind)
    if q.brand:
        out = out.join(brands.where(T.contains_ci(F.col("name"), F.lit(q.brand))).select(F.col("id").alias("brand_id")), "brand_id", "left_semi")
    attributes = [("ram", F.col("numeric_value") >= ram_min) if ram_min is not None else None, ("ram", F.col("numeric_value") <= ram_max) if ram_max is not None else None]
    attributes += [(key, T.contains_ci(F.col("value"), F.lit(wanted))) if wanted else None for key, wanted in (("cpu", q.cpu), ("gpu", q.gpu))]
    asked = [x for x in attributes if x]
    if asked:
        keys = sorted({key for key, _ in asked})
        out = _meeting_all(out, _attribute_rows(variants, values, definitions, keys), [(F.col("key") == key) & rule for key, rule in asked])
    bounds = [T.contains_ci(F.col("color"), F.lit(q.color)) if q.color else None, F.col("price") >= q.price_min if q.price_min is not None else None, F.col("price") <= q.price_max if q.price_max is not None else None]
    out = _meeting_all(out, variants.withColumnRenamed("product_id", "owner"), [b for b in bounds if b is not None])
    if not specific and named["terms"]:
        documents = search_documents(out, brands, categories, variants, values, definitions).where(T.all_terms_in(F.col("document"), F.array(*map(F.lit, named["terms"]))))
        out = out.join(documents.select("id"), "id", "left_semi")
    return out.select(*products.columns).orderBy(F.col("id").desc()).limit(clamped_limit(q.limit, 5, 10))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as a JSON document."""
    return rows.select("id", F.to_json(F.struct(*rows.columns)).alias("document"))
