"""Column functions on JSON payloads, arrays and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import text as T
from vitrine.functions.numbers import clamp
from vitrine.functions.urls import canonical_page, host, is_safe_selector
from vitrine.schemas import PAYLOADS, VOCABULARIES


def path(json: Column, *paths: str, default: str | None = None) -> Column:
    """The first of several paths that holds something, or the default."""
    found = [F.get_json_object(json, f"$.{p}") for p in paths]
    return F.coalesce(*found, *([F.lit(default)] if default is not None else []))


def variant_path(json: Column, p: str, kind: str) -> Column:
    """A typed value of a payload without a contract; null for malformed JSON."""
    return F.try_variant_get(F.try_parse_json(json), f"$.{p}", kind)


def parsed(json: Column, payload: str) -> Column:
    """A payload by its contract; malformed JSON is null."""
    return F.from_json(json, PAYLOADS[payload], {"mode": "PERMISSIVE"})


def message_ids(json: Column) -> Column:
    """All message ids anywhere in a payload, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(T.text(json), F.lit(r'"message_id"\s*:\s*(\d+)'), F.lit(1)), lambda x: x.cast("long")))


def positive_ids(values: Column, most: int = 100) -> Column:
    """Whole positive numbers among texts, distinct, at most ``most``."""
    numbers = F.transform(values, lambda x: F.when(x.cast("string").rlike(r"^\d+$"), x.cast("string").try_cast("long")))
    return F.slice(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x > 0))), 1, most)


def bound_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, although ``use`` names it several times or within lambdas."""
    return F.transform(F.array(value), use)[0]


def first_where(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.try_element_at(F.filter(values, test), F.lit(1))


def last(values: Column, n: int) -> Column:
    """The last ``n`` elements, or all if there are fewer."""
    return F.when(F.size(values) <= n, values).otherwise(F.slice(values, -n, n))


def union_in_order(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))


def distinct_ci(values: Column) -> Column:
    """Distinct regardless of case, the first spelling kept."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x))))


def distinct_by(values: Column, key: Callable[[Column], Column], empty: str) -> Column:
    """Distinct by a key, the first kept; ``empty`` is the type of the array."""
    return F.aggregate(values, F.array().cast(empty), lambda kept, x: F.when(F.exists(kept, lambda k: key(k) == key(x)), kept).otherwise(F.concat(kept, F.array(x))))


def lookup(values: dict[str, object], key: Column, default: object) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), F.lit(default))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


# ---- contracts ---------------------------------------------------------------------------------

_SOURCE = "array<struct<title:string,url:string,type:string,image_urls:array<string>>>"


def is_http_url(u: Column) -> Column:
    return F.coalesce(u.rlike(r"(?i)^https?://[^\s/?#]+\.[^\s]*$") & (F.length(u) <= 2048) & (host(u) != ""), F.lit(False))


def normalized_specifications(specs: Column, most: int = 100) -> Column:
    """Specifications with a name and a value, keys in snake case, at most ``most``."""
    cleaned = F.transform(specs, lambda s: F.struct(
        F.coalesce(F.nullif(T.slug_ascii(F.coalesce(s["key"], s["name"]), "_"), F.lit("")), F.lit("attribute")).alias("key"),
        T.clip(F.trim(F.coalesce(s["name"], s["key"], F.lit(""))), 255).alias("name"), T.clip(F.trim(F.coalesce(s["value"], F.lit(""))), 1000).alias("value")))
    return F.slice(F.filter(cleaned, lambda s: (s["name"] != "") & (s["value"] != "")), 1, most)


def normalized_sources(sources: Column, primary: Column, most: int = 20) -> Column:
    """Well-formed sources, canonical and distinct by page, the primary one first, at most ``most``."""
    cleaned = F.transform(sources, lambda s: F.struct(
        T.clip(F.coalesce(F.nullif(F.trim(s["title"]), F.lit("")), s["url"]), 255).alias("title"), canonical_page(F.trim(s["url"])).alias("url"),
        F.when(s["type"].isin(VOCABULARIES["source_type"]), s["type"]).otherwise("web").alias("type"),
        F.slice(F.array_distinct(F.filter(F.coalesce(s["image_urls"], F.array().cast("array<string>")), is_http_url)), 1, 10).alias("image_urls")))
    both = F.struct(F.filter(cleaned, lambda s: is_http_url(s["url"])).alias("good"), canonical_page(F.trim(primary)).alias("main"))
    ordered = bound_once(both, lambda b: F.concat(F.filter(b["good"], lambda s: s["url"] == b["main"]), F.filter(b["good"], lambda s: ~s["url"].eqNullSafe(b["main"]))))
    return F.slice(distinct_by(ordered, lambda s: s["url"], _SOURCE), 1, most)


def normalized_draft(draft: Column) -> Column:
    """A researched draft within its bounds: texts clipped, lists cleaned, confidence between 0 and 1."""
    return F.struct(
        T.clip(F.trim(T.text(draft["title"])), 255).alias("title"), T.clip(F.trim(draft["brand"]), 255).alias("brand"), T.clip(F.trim(draft["model"]), 255).alias("model"),
        normalized_specifications(draft["specifications"]).alias("specifications"), normalized_sources(draft["sources"], draft["primary_source_url"]).alias("sources"),
        F.slice(F.array_distinct(F.filter(F.coalesce(draft["image_urls"], F.array().cast("array<string>")), is_http_url)), 1, 10).alias("image_urls"),
        F.coalesce(clamp(draft["confidence"].cast("double"), 0.0, 1.0), F.lit(0.0)).alias("confidence"),
    )


def discovered_urls(found: Column, most: int = 60) -> Column:
    """Picture addresses of a discovery: those paired with a page if there are any, else the flat list."""
    paired = F.flatten(F.transform(F.coalesce(found["sources"], F.array().cast("array<struct<page_url:string,image_urls:array<string>>>")), lambda s: F.coalesce(s["image_urls"], F.array().cast("array<string>"))))
    flat = F.coalesce(found["image_urls"], F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.filter(F.when(F.size(paired) == 0, flat).otherwise(paired), is_http_url)), 1, most)


def discovered_pages(found: Column, most: int = 20) -> Column:
    """Pages of a discovery, with or without pictures, distinct."""
    paired = F.transform(F.coalesce(found["sources"], F.array().cast("array<struct<page_url:string,image_urls:array<string>>>")), lambda s: s["page_url"])
    return F.slice(F.array_distinct(F.filter(F.concat(paired, F.coalesce(found["page_urls"], F.array().cast("array<string>"))), is_http_url)), 1, most)


def matched_selectors(selectors: Column, matched: Column, most: int) -> Column:
    """Selectors that matched something on the page, at most ``most``."""
    return F.slice(F.filter(selectors, lambda s: F.array_contains(matched, s)), 1, most)


def cleaned_recipe(recipe: Column) -> Column:
    """A recipe with safe, distinct selectors, lower-case attributes and clamped numbers."""
    safe = lambda a, n: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda s: F.trim(s)), is_safe_selector)), 1, n)
    return F.struct(
        safe(recipe["collect_selectors"], 20).alias("collect_selectors"), safe(recipe["click_selectors"], 20).alias("click_selectors"),
        F.slice(F.array_distinct(F.transform(F.coalesce(recipe["attributes"], F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))), 1, 20).alias("attributes"),
        clamp(F.coalesce(recipe["max_clicks"], F.lit(0)), 0, 40).alias("max_clicks"), clamp(F.coalesce(recipe["wait_ms"], F.lit(500)), 100, 5000).alias("wait_ms"),
    )


def with_fields(json: Column, payload: str, **fields: Column) -> Column:
    """A JSON document with some fields of its contract replaced, all others as they were."""
    value = parsed(json, payload)
    for name, new in fields.items():
        value = value.withField(name, new)
    return F.to_json(value)


def prompt_context(title: Column, urls: Column, specs: Column, n: int = 10) -> Column:
    """Context lines of a request with capped lists."""
    lines = F.transform(F.slice(specs, 1, n), lambda s: F.concat(s["name"], F.lit(": "), s["value"]))
    return F.concat_ws("\n", F.concat(F.lit("Product: "), title), F.concat(F.lit("Known pages: "), F.array_join(F.slice(urls, 1, n), ", ")), F.concat(F.lit("Specifications: "), F.array_join(lines, "; ")))
