"""Schemas of the catalogue's tables and of their nested payloads, and its closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES: dict[str, str] = {
    "brands": "id long, name string, slug string, country string, website_url string, is_active boolean",
    "categories": "id long, parent_id long, name string, slug string, icon string, sort_order long, is_active boolean",
    "category_translations": "category_id long, locale string, name string",
    "products": "id long, category_id long, brand_id long, canonical_key string, product_type string, status string, slug string, title string, model string, description string, confidence decimal(5,4), is_active boolean, is_featured boolean, sort_order long, published_at timestamp",
    "variants": "id long, product_id long, fingerprint string, name string, sku string, mpn string, gtin string, color string, condition string, price decimal(12,2), compare_at_price decimal(12,2), currency string, stock_status string, quantity long, warranty_months int, is_default boolean, is_active boolean",
    "attribute_definitions": "id long, key string, label string, data_type string, default_unit string, is_filterable boolean, is_variant boolean, sort_order long",
    "attribute_definition_category": "attribute_definition_id long, category_id long, sort_order long",
    "attribute_values": "id long, attribute_definition_id long, product_id long, product_variant_id long, value string, normalized_value string, numeric_value decimal(14,4), boolean_value boolean, unit string",
    "media": "id long, product_id long, type string, disk string, path string, url string, source_url string, role string, width long, height long, checksum string, verification_status string, verification_score decimal(5,4), sort_order long, is_primary boolean",
    "sources": "id long, product_id long, product_variant_id long, product_draft_id long, title string, url string, domain string, source_type string, retrieved_at timestamp, confidence decimal(5,4)",
    "drafts": "id long, telegram_update_id long, ai_run_id long, status string, title string, brand string, model string, product_type string, category string, color string, description string, research_notes string, specifications array<struct<key:string,name:string,value:string>>, sources array<struct<title:string,url:string,type:string,image_urls:array<string>>>, image_urls array<string>, primary_source_url string, confidence decimal(5,4), excluded_gallery_source_urls array<string>, excluded_gallery_image_urls array<string>, excluded_gallery_hashes array<string>",
    "draft_media": "id long, product_draft_id long, path string, checksum string, width long, height long, sort_order long, is_primary boolean, role string",
    "recipes": "domain string, path_pattern string, status string, source_blocked boolean, success_count long, failure_count long, last_failure_kind string, retry_after timestamp, consecutive_hard_blocks long, hard_block_urls array<string>",
    "recipe_versions": "id long, recipe_id long, trigger string, status string, recipe string, scout string, result string, score decimal(6,2), created_at timestamp",
    "source_stats": "domain string, attempt_count long, extraction_success_count long, accepted_gallery_count long, accepted_image_count long, failure_count long, last_failure_kind string, last_attempt_at timestamp, last_success_at timestamp",
    "source_attempts": "id long, telegram_update_id long, product_draft_id long, domain string, product_url string, actor string, phase string, action string, status string, decision string, round int, input string, output string, message string, duration_ms long, created_at timestamp",
    "updates": "update_id long, telegram_user_id string, chat_id string, message_id long, text string, payload string, status string, created_at timestamp",
    "chat_states": "chat_id string, provider string, model string, state string",
    "ai_runs": "id long, telegram_update_id long, provider string, model string, status string, prompt string, usage string, started_at timestamp, completed_at timestamp, created_at timestamp",
    "operations": "id long, idempotency_key string, tool string, action string, target_type string, target_id long, payload string, result string, status string",
    "ai_models": "provider string, model string, input_per_million decimal(12,6), cached_input_per_million decimal(12,6), output_per_million decimal(12,6), is_available boolean, is_enabled boolean",
    "settings": "key string, value string",
    "jobs": "id long, queue string, attempts int, reserved_at long, available_at long, created_at long",
    "failed_jobs": "id long, uuid string, queue string, exception string, failed_at timestamp",
    "messages": "id long, conversation_id long, role string, content string, updated_at timestamp",
    "failures": "domain string, kind string, url string, at timestamp, success boolean",
    "images": "draft_id long, pos int, url string, page_url string, width int, height int, sha256 string, luma array<double>",
    "reviews": "draft_id long, index int, exact_match boolean, color_match boolean, publishable boolean, kind string, view string, gallery_rank int, score int, reason string",
}

PAYLOADS: dict[str, str] = {
    "specifications": "array<struct<key:string,name:string,value:string>>",
    "sources": "array<struct<title:string,url:string,type:string,image_urls:array<string>>>",
    "discovery": "struct<sources:array<struct<page_url:string,image_urls:array<string>>>,image_urls:array<string>,page_urls:array<string>>",
    "preflight": "struct<decision:string,gallery_likely:boolean,expected_image_count:int,evidence:array<string>,confidence:double,reason:string>",
    "recipe": "struct<collect_selectors:array<string>,click_selectors:array<string>,attributes:array<string>,max_clicks:int,wait_ms:int>",
    "reviews": "array<struct<index:int,exact_match:boolean,color_match:boolean,publishable:boolean,kind:string,view:string,gallery_rank:int,score:int,reason:string>>",
}

VOCABULARIES: dict[str, list[str]] = {
    "product_type": ["laptop", "desktop", "component", "other"],
    "product_status": ["published", "draft", "archived"],
    "condition": ["new", "used", "refurbished"],
    "stock_status": ["in_stock", "out_of_stock", "preorder", "unknown"],
    "source_type": ["manufacturer", "retailer", "marketplace", "review", "database", "web"],
    "displayable": ["verified", "source_verified", "manual"],
    "draft_status": ["pending_review", "approved", "rejected"],
    "gallery_status": ["pending", "complete", "partial", "missing"],
    "recipe_status": ["learning", "active", "disabled"],
    "version_status": ["scouting", "training", "skipped", "deferred", "promoted", "partial", "rejected", "failed"],
    "failure_kind": ["access_gate", "rate_limited", "recipe_mismatch", "dom_unusable", "browser_timeout", "browser_protocol", "browser_process", "browser_unavailable", "ai_timeout", "ai_rate_limited", "ai_transient", "ai_error"],
    "actor": ["web_search", "html", "html_resolver", "downloader", "ai", "playwright", "vision", "system"],
    "image_role": ["primary", "secondary", "detail"],
}

CATEGORY_OF_TYPE = {"laptop": "laptops", "desktop": "computers", "component": "components"}
#: Seed rows.
SEED_CATEGORIES = [(1, "laptops", "Laptops", 10), (2, "computers", "Computers", 20), (3, "components", "Components", 30), (4, "other-tech", "Other tech", 40)]
FILTERABLE_ATTRIBUTES = ["cpu", "gpu", "ram", "storage", "display", "screen_size", "refresh_rate"]


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def frame(spark: SparkSession, name: str, *rows: dict) -> DataFrame:
    """A small frame of a catalogue table; columns that a row leaves out are null."""
    out = empty(spark, name)
    return spark.createDataFrame([tuple(r.get(c) for c in out.columns) for r in rows], out.schema)


def in_vocabulary(c: Column, name: str) -> Column:
    return c.isin(VOCABULARIES[name])


def seed_categories(spark: SparkSession) -> DataFrame:
    """The four categories every catalogue begins with."""
    return spark.createDataFrame(SEED_CATEGORIES, "id long, slug string, name string, sort_order long")
