"""HTML as tables: gallery pictures by a table function, links and titles by native expressions."""

from __future__ import annotations

import html as _html
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vitrine.functions import urls as U
from vitrine.functions.text import text

# ---- fixed values ------------------------------------------------------------------------------

GALLERY_WORDS = ["gallery", "slider", "swiper", "carousel", "product-image", "product-media"]
#: (tag or "*", attribute), in order of preference, inside a gallery.
GALLERY_ATTRIBUTES = [
    ("*", "data-old-hires"), ("img", "data-zoom-image"), ("img", "data-large_image"), ("img", "data-full"), ("img", "data-full-src"), ("img", "data-hires"), ("img", "data-original"),
    ("img", "data-image"), ("img", "data-src"), ("source", "src"), ("img", "src"),
]
#: (attribute, value) of meta tags with a picture in their content.
META_IMAGES = [("property", "og:image"), ("property", "og:image:url"), ("property", "og:image:secure_url"), ("name", "twitter:image"), ("name", "twitter:image:src"), ("itemprop", "image")]
#: The same anywhere on the page.
PAGE_ATTRIBUTES = [
    ("*", "data-old-hires"), ("img", "data-full"), ("img", "data-full-src"), ("img", "data-hires"), ("img", "data-image"), ("img", "data-zoom-image"), ("img", "data-large_image"),
    ("img", "data-original"), ("img", "data-lazy-src"), ("img", "data-src"), ("img", "src"), ("source", "src"),
]
SRCSETS = [("img", "srcset"), ("img", "data-srcset"), ("source", "srcset")]
STRUCTURED_KEYS = ["image", "contenturl", "thumbnailurl"]
SCRIPT_TYPES = [None, "application/json", "text/javascript", "application/javascript"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
LARGEST_PAGE = 5_000_000


# ---- native expressions ------------------------------------------------------------------------


def links(page: Column) -> Column:
    """Targets of all links, in order."""
    return F.regexp_extract_all(text(page), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def title(page: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(text(page), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def without_tags(page: Column) -> Column:
    return F.regexp_replace(text(page), "<[^>]*>", "")


@F.pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    """All named and numbered entities, for texts beyond the common five."""
    return values.map(lambda v: None if v is None else _html.unescape(v))


# ---- the table function ------------------------------------------------------------------------


class _Page(HTMLParser):
    """Collects what may hold a picture: attributes of tags inside and outside galleries, meta tags, scripts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[tuple[str, dict[str, str], bool]] = []
        self.scripts: list[tuple[str | None, str]] = []
        self._open: list[tuple[str, bool]] = []
        self._script: str | None = None
        self._in_script = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k.lower(): v or "" for k, v in attrs}
        inside = bool(self._open) and self._open[-1][1]
        self.tags.append((tag, own, inside))
        if tag == "script":
            self._script, self._in_script = own.get("type"), True
        if tag not in VOID_TAGS:
            names = f"{own.get('class', '')} {own.get('id', '')}".lower()
            self._open.append((tag, inside or any(w in names for w in GALLERY_WORDS)))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags.append((tag, {k.lower(): v or "" for k, v in attrs}, bool(self._open) and self._open[-1][1]))

    def handle_endtag(self, tag: str) -> None:
        self._in_script = self._in_script and tag != "script"
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                del self._open[i:]
                break

    def handle_data(self, data: str) -> None:
        if self._in_script:
            self.scripts.append((self._script, data))


def _structured(value: object, parent: str | None, out: list[str]) -> None:
    """Pictures of structured data: under an image key, or an address below one."""
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for key, item in items:
        name = key.lower() if isinstance(key, str) else parent
        if isinstance(item, str):
            if name in STRUCTURED_KEYS or (parent == "image" and name in ("url", "src")):
                out.append(item)
        else:
            _structured(item, name, out)


def page_candidates(page: str) -> list[str]:
    """Picture candidates of a page as they stand there, best places first."""
    if not page or len(page) > LARGEST_PAGE:
        return []
    parser = _Page()
    parser.feed(page)
    parser.close()
    fits = lambda tag, wanted: wanted in ("*", tag)
    out = [a[name] for wanted, name in GALLERY_ATTRIBUTES for tag, a, inside in parser.tags if inside and fits(tag, wanted) and name in a]
    out += [a.get("content", "") for name, value in META_IMAGES for tag, a, _ in parser.tags if tag == "meta" and a.get(name) == value]
    out += [a["href"] for tag, a, _ in parser.tags if tag == "link" and a.get("rel") == "image_src" and "href" in a]
    out += [a[name] for wanted, name in PAGE_ATTRIBUTES for tag, a, _ in parser.tags if fits(tag, wanted) and name in a]
    for gallery in (True, False):
        for wanted, name in SRCSETS:
            for tag, a, inside in parser.tags:
                if (inside or not gallery) and fits(tag, wanted) and name in a:
                    out += [parts[0] for entry in reversed(a[name].split(",")) if (parts := entry.split())]
    for kind, body in parser.scripts:
        if kind == "application/ld+json":
            try:
                _structured(json.loads(_html.unescape(body)), None, out)
            except ValueError:
                pass
    for kind, body in parser.scripts:
        if kind in SCRIPT_TYPES and len(body) <= 2_000_000:
            plain = _html.unescape(body).replace("\\/", "/").replace("\\u002F", "/")
            out += re.findall(r"(?i)https?://[^\"'<>\s\\]+?\.(?:jpe?g|png|webp|avif)(?:\?[^\"'<>\s\\]*)?", plain)
    return [c.strip() for c in out if c.strip()]


def gallery(pages: DataFrame, key: str = "url", body: str = "body", most: int = 60) -> DataFrame:
    """(key, pos, image): the pictures of each page, whole addresses, distinct, in order, at most ``most`` a page.

    The parser runs in a table function; normalising, ordering and the limit are native.
    """
    spark = pages.sparkSession

    class Candidates:
        def eval(self, page: str):
            yield from enumerate(page_candidates(page))

    spark.udtf.register("page_candidates", F.udtf(Candidates, returnType="pos: int, candidate: string"))
    rows = spark.sql("SELECT p.__key, c.pos, c.candidate FROM {pages} p, LATERAL page_candidates(p.__body) c", pages=pages.select(F.col(key).alias("__key"), F.col(body).alias("__body")))
    good = rows.withColumn("image", U.image_candidate(F.col("candidate"), F.col("__key"))).where("image IS NOT NULL").groupBy("__key", "image").agg(F.min("pos").alias("pos"))
    from pyspark.sql import Window

    placed = good.withColumn("pos", F.row_number().over(Window.partitionBy("__key").orderBy("pos")))
    return placed.where(F.col("pos") <= most).select(F.col("__key").alias(key), "pos", "image")


def structured_images(spark: SparkSession, documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, image) of JSON documents walked as variants to three levels, natively: image keys that hold an address or a list or object of them."""
    parsed = documents.select(F.col(key).alias("k"), F.try_parse_json(F.col(body)).alias("v")).where("v IS NOT NULL")
    return spark.sql("""
        WITH one AS (SELECT k, lower(e.key) AS name, e.value AS v FROM {parsed}, LATERAL variant_explode(v) e),
             two AS (SELECT k, one.name AS parent, coalesce(lower(e.key), one.name) AS name, e.value AS v FROM one, LATERAL variant_explode(one.v) e),
             three AS (SELECT k, two.name AS parent, coalesce(lower(e.key), two.name) AS name, e.value AS v FROM two, LATERAL variant_explode(two.v) e),
             every AS (SELECT k, CAST(NULL AS string) AS parent, name, v FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)
        SELECT k, try_cast(v AS string) AS image FROM every
        WHERE schema_of_variant(v) = 'STRING' AND (name IN ('image', 'contenturl', 'thumbnailurl') OR (parent = 'image' AND name IN ('url', 'src')))""", parsed=parsed).withColumnRenamed("k", key)
