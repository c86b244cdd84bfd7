"""The test tables as catalogue tables.

Each binding is one SQL text that Spark and DuckDB both read: ``{part}`` stands for a test table. The
queries run the library's operators on the bound frames; their oracles put the same text into a
``WITH`` clause and state the operator's meaning in SQL of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vitrine.session import table



def _values(name: str, parts: list[str]) -> str:
    """A numbered list of texts as a table (k, part)."""
    return f"(VALUES {', '.join(f'({k}, {chr(39)}{part}{chr(39)})' for k, part in enumerate(parts))}) AS {name}(k, part)"


#: Parts that addresses are put together from: ordinary ones, and one for each rule that gates or rewrites them.
HOSTS = ["https://x.example", "http://www.shop.example:8080", "https://192.168.1.4", "https://172.20.0.9", "https://8.8.4.4", "https://localhost", "ftp://files.example", "https://www.bhphoto.com", "https://m.media-amazon.com", "https://psref.lenovo.com", "https://i.dell.com", "https://sub.localhost", "https://dlcdnwebimgs.asus.com"]
PATHS = [
    "", "/", "/a/photo.jpg", "/img/site-LOGO.bmp", "/a/w500", "/a/w640/big", "/a/h299", "/a/W300/", "/a/b.PDF", "/c/d.docx", "/thumbs/c.jpg", "/x_small.webp", "/icons/i.png", "/header/h.avif", "/manual/read", "/support/drivers/x", "/avatar/me.jpeg", "/e.svg",
    "/images/images500x500/p.JPG", "/images/images150x150/p.jpg", "/I/81abc._AC_SX300_.jpg", "/I/81abc._AC_SL1500_.png", "/is/image/dell/front", "/gain/12//w184", "/video/clip.jpg", "/a/spin/1.jpg", "/data/certificate.html", "/social/f.png", "/z/pixel.gif",
]
QUERIES = ["", "?x=1", "?width=640&id=7", "?wid=90&hei=64&scl=2", "?q=80&w=1200#top", "#frag", "?fit=crop"]
CANDIDATES = [
    "/p/a.jpg", "//cdn.example/b.png", "c.webp", "https://o.example/d.jpg?a=1&amp;b=2", " /e.jpg ", "#zoom", "data:image/png;base64,xx", "BLOB:x", "", "https://j.example/f.jpg", "/Logo.png", "/thumb/g.jpg", "/tracking/h.gif", "../up/i.jpg", "HTTP://u.example/K.JPG", "/photo/l.jpg#x",
]

BOUND: dict[str, str] = {
    "addresses": f"""
        SELECT page_id, url AS page, concat(h.part, p.part, q.part) AS address FROM {{pages}}
        JOIN {_values("h", HOSTS)} ON h.k = page_id % {len(HOSTS)} JOIN {_values("p", PATHS)} ON p.k = page_id % {len(PATHS)} JOIN {_values("q", QUERIES)} ON q.k = page_id % {len(QUERIES)}""",
    "candidates": f"SELECT page_id, url AS page, c.part AS candidate FROM {{pages}} JOIN {_values('c', CANDIDATES)} ON c.k = page_id % {len(CANDIDATES)}",
    "products": """
        SELECT p_partkey AS id, CAST(p_size % 5 AS BIGINT) AS category_id, CAST(substring(p_brand, 7) AS BIGINT) AS brand_id, p_type AS product_type,
               CASE WHEN p_size <= 40 THEN 'published' ELSE 'draft' END AS status, lower(p_name) AS slug, p_name AS title, p_type AS model, p_brand AS description,
               p_size % 7 <> 0 AS is_active, CAST(p_size AS BIGINT) AS sort_order, p_retailprice AS published_at FROM {part}""",
    "brands": """
        SELECT b.id, b.name, lower(b.name) AS slug, n_name AS country, b.id % 10 <> 1 AS is_active
        FROM (SELECT DISTINCT CAST(substring(p_brand, 7) AS BIGINT) AS id, p_brand AS name FROM {part}) b JOIN {nation} ON n_nationkey = b.id % 25""",
    "categories": """
        SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, lower(r_name) AS slug, CAST(r_regionkey AS BIGINT) AS sort_order, r_regionkey <> 4 AS is_active FROM {region}
        UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), n_name, lower(n_name), CAST(n_nationkey AS BIGINT), true FROM {nation}""",
    "category_translations": "SELECT CAST(r_regionkey AS BIGINT) AS category_id, 'en' AS locale, r_name AS name FROM {region} UNION ALL SELECT CAST(r_regionkey AS BIGINT), 'cs', lower(r_name) FROM {region} WHERE r_regionkey <> 2",
    "variants": """
        SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey AS id, l_partkey AS product_id, 'line' AS name, concat('SKU-', CAST(l_orderkey AS VARCHAR(20))) AS sku, CAST(NULL AS VARCHAR(20)) AS mpn,
               CAST(NULL AS VARCHAR(20)) AS gtin, l_returnflag AS color, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CASE WHEN l_tax > 0.04 THEN 'EUR' ELSE '' END AS currency,
               CASE WHEN l_quantity > 25 THEN 'in_stock' WHEN l_quantity > 5 THEN 'out_of_stock' ELSE '' END AS stock_status, CAST(l_quantity AS BIGINT) AS quantity, l_linenumber = 1 AS is_default,
               l_linestatus = 'O' AND l_discount >= 0.03 AS is_active FROM {lineitem}""",
    "attribute_definitions": "SELECT CAST(1 AS BIGINT) AS id, 'ram' AS key, 'Memory' AS label, true AS is_filterable, CAST(1 AS BIGINT) AS sort_order UNION ALL SELECT CAST(2 AS BIGINT), 'size', 'Size', false, CAST(2 AS BIGINT) UNION ALL SELECT CAST(3 AS BIGINT), 'unused', 'Unused', false, CAST(3 AS BIGINT)",
    "attribute_values": """
        SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey AS id, CAST(1 AS BIGINT) AS attribute_definition_id, CAST(NULL AS BIGINT) AS product_id, l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey AS product_variant_id,
               concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), ' GB') AS value, concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), ' gb') AS normalized_value, l_quantity AS numeric_value, 'GB' AS unit FROM {lineitem}
        UNION ALL SELECT p_partkey, CAST(2 AS BIGINT), p_partkey, CAST(NULL AS BIGINT), CAST(p_size AS VARCHAR(20)), CAST(p_size AS VARCHAR(20)), CAST(p_size AS DOUBLE), CAST(NULL AS VARCHAR(20)) FROM {part}""",
    "media": """
        SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_suppkey AS id, l_partkey AS product_id, CASE WHEN l_linenumber % 2 = 0 THEN 'public' ELSE 'remote' END AS disk, concat('p/', CAST(l_orderkey AS VARCHAR(20)), '.webp') AS path,
               concat('https://img.example/', CAST(l_orderkey AS VARCHAR(20)), '.jpg') AS url, CASE WHEN l_returnflag = 'A' THEN 'verified' WHEN l_returnflag = 'N' THEN 'rejected' ELSE 'manual' END AS verification_status,
               CAST(l_suppkey AS BIGINT) AS sort_order, l_linenumber = 1 AS is_primary, CAST(l_quantity * 40 AS BIGINT) AS width, CAST(l_quantity * 30 AS BIGINT) AS height FROM {lineitem}""",
    "ai_runs": """
        SELECT event_id AS id, user_id AS telegram_update_id, CASE WHEN event_type IN ('view', 'click') THEN 'openai' ELSE 'other' END AS provider, event_type AS model, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN CAST(NULL AS VARCHAR(99)) ELSE concat('{{"prompt_tokens":', CAST(user_id * 10 AS VARCHAR(20)), ',"cache_read_input_tokens":', CAST(event_id % 50 AS VARCHAR(20)), ',"output_tokens":', CAST(event_id % 7 AS VARCHAR(20)), '}}') END AS usage,
               concat('prompt ', CAST(event_id % 4 AS VARCHAR(20))) AS prompt, ts AS created_at FROM {events}""",
    "ai_models": """
        SELECT CASE WHEN event_type IN ('view', 'click') THEN 'openai' ELSE 'other' END AS provider, event_type AS model,
               CAST(CASE event_type WHEN 'view' THEN 2.5 WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 3 ELSE 1 END AS DECIMAL(12,6)) AS input_per_million,
               CAST(CASE event_type WHEN 'view' THEN 0.25 WHEN 'click' THEN 0.05 WHEN 'purchase' THEN 0.3 END AS DECIMAL(12,6)) AS cached_input_per_million,
               CAST(CASE event_type WHEN 'view' THEN 15 WHEN 'click' THEN 1.5 WHEN 'purchase' THEN 9 ELSE 2 END AS DECIMAL(12,6)) AS output_per_million
        FROM (SELECT DISTINCT event_type FROM {events} WHERE event_type IN ('view', 'click', 'purchase', 'error')) kinds""",
    "attempts": """
        SELECT event_id AS id, concat('s', CAST(user_id AS VARCHAR(20)), '.shop.example') AS domain, CASE WHEN event_type IN ('view', 'click') THEN 'extracted' WHEN event_type = 'purchase' THEN 'accepted' WHEN event_type = 'error' THEN 'failed' ELSE 'none' END AS outcome,
               CAST(event_id % 6 AS BIGINT) AS images, CASE WHEN event_type <> 'error' THEN CAST(NULL AS VARCHAR(30)) WHEN event_id % 3 = 0 THEN 'access_gate' WHEN event_id % 3 = 1 THEN 'browser_timeout' ELSE 'recipe_mismatch' END AS kind, ts AS at FROM {events}""",
    "failures": """
        SELECT event_id AS id, concat('d', CAST(user_id AS VARCHAR(20))) AS domain, ts AS at, CASE WHEN event_type = 'error' THEN 'browser_timeout' WHEN event_type = 'click' THEN 'recipe_mismatch' WHEN event_type = 'signup' THEN 'rate_limited' ELSE CAST(NULL AS VARCHAR(30)) END AS kind FROM {events}""",
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalogue table over the test tables."""
    sql = BOUND[name]
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def with_bound(sql: str, *names: str) -> str:
    """DuckDB SQL in which the bound tables ``names`` can be used."""
    plain = lambda s: re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", s).replace("{{", "{").replace("}}", "}")
    return "WITH " + ", ".join(f"{n} AS ({plain(BOUND[n])})" for n in names) + sql
