"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from vitrine.functions import html as H
from vitrine.functions import numbers as N
from vitrine.functions import payloads as P
from vitrine.functions import text as T
from vitrine.functions import urls as U


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("brand", "model", "title", "key"), [("Lenovo", "Legion 5 16IRX9", "x", "lenovo-legion-5-16irx9"), ("ASUS", None, "ROG NUC 2025", "asus-rog-nuc-2025"), ("ASUS", "", "ROG NUC 2025", "asus-rog-nuc-2025")])
def test_identity_key(spark, brand, model, title, key):
    assert value(spark, N.identity_key(lit(brand), lit(model).cast("string"), lit(title))) == key


@pytest.mark.parametrize(("url", "supported"), [("https://x.example/lenovo-16irx9", True), ("https://x.example/p/2025", True), ("https://x.example/gaming-legion-pink", True), ("https://x.example/legion-pink", False), ("https://x.example/other", False)])
def test_identity_match(spark, url, supported):
    tokens = T.identity_tokens(lit("16IRX9 2025"), lit("Legion Gaming"), lit("Pink"))
    assert value(spark, T.identity_supported(tokens, lit(url))) is supported


def test_transliteration_and_slugs(spark):
    assert value(spark, T.slug(lit("Černý Ноутбук №1"))) == "cerny-noutbuk-1"
    assert value(spark, T.slug_unicode(lit("Crème Brûlée"))) == "creme-brulee"
    assert value(spark, T.canonical_attribute_key(lit("!!!"))).startswith("attribute_")


def test_html_entities_and_links(spark):
    assert value(spark, H.unescaped(lit("a &eacute; &amp; b"))) == "a é & b"
    assert value(spark, H.links(lit("<a class=x href='/a'>b</a><A HREF=\"c\">"))) == ["/a", "c"]


def test_gallery_order_and_markers(spark):
    page = """<meta property="og:image" content="/og.jpg"><div id="Main-Gallery"><img data-zoom-image="//cdn.example/z.jpg" src="s.jpg"><img srcset="a.jpg 1x, b.jpg 2x"></div>
      <img src="/logo.png"><img src="data:image/png;base64,xx"><script type="application/ld+json">{"image": {"url": "https://x.example/ld.jpg"}, "name": "n"}</script><script>var a = "https:\\/\\/x.example\\/s.webp";</script>"""
    pages = spark.createDataFrame([("https://x.example/p/1", page), ("https://x.example/p/2", None)], "url string, body string")
    found = [r["image"] for r in H.gallery(pages).orderBy("pos").collect()]
    assert found[:3] == ["https://cdn.example/z.jpg", "https://x.example/p/s.jpg", "https://x.example/og.jpg"]
    assert found[-2:] == ["https://x.example/ld.jpg", "https://x.example/s.webp"] and not any("logo" in f for f in found)
    assert found.index("https://x.example/p/b.jpg") < found.index("https://x.example/p/a.jpg")


def test_structured_images(spark):
    rows = spark.createDataFrame([(1, '{"image": ["https://x/1.jpg", {"url": "https://x/2.jpg"}], "offers": {"thumbnailUrl": "https://x/3.jpg", "url": "no"}}')], "k int, body string")
    assert sorted(r["image"] for r in H.structured_images(spark, rows, "k", "body").collect()) == ["https://x/1.jpg", "https://x/2.jpg", "https://x/3.jpg"]


@pytest.mark.parametrize(("url", "public"), [("http://localhost/a", False), ("http://10.0.0.1/a", False), ("http://[::1]/a", False), ("ftp://x.example/a", False), ("https://x.example/a", True), ("https://8.8.8.8/", True), ("nonsense", False)])
def test_public_addresses(spark, url, public):
    assert value(spark, U.is_public(lit(url))) is public


def test_host_drops_everything_to_the_first_www(spark):
    assert value(spark, U.host(lit("https://shop.www.x.example/a"))) == "x.example"
    assert value(spark, U.host(lit(None).cast("string"))) == ""


def test_picture_hash(spark):
    up, down = [float(c) for r in range(8) for c in range(9)], [float(-c) for r in range(8) for c in range(9)]
    halves = lambda luma: N.hash_halves(N.difference_bits(F.array(*map(F.lit, luma))))
    assert value(spark, N.hamming(halves(up), halves(up))) == 0
    assert value(spark, N.hamming(halves(up), halves(down))) == 64
    assert value(spark, N.hash_hex(halves(down))) == "f" * 16


def test_probe_side_and_time_budget(spark):
    side = lambda seen: N.probe_minimum_side(lit(600), lit(400), lit(True), lit(6), lit(seen))
    assert value(spark, side(6)) == 400 and value(spark, side(1)) == 600
    left = N.remaining_seconds(F.timestamp_seconds(lit(0)), F.timestamp_seconds(lit(900)))
    assert value(spark, left) == 180 and value(spark, N.can_start(left, 181)) is False


def test_draft_contract_bounds(spark):
    sources = F.concat(F.transform(F.sequence(lit(1), lit(25)), lambda i: F.struct(lit("t").alias("title"), F.concat(lit("https://r"), i.cast("string"), lit(".example/p")).alias("url"), lit("retailer").alias("type"), F.array().cast("array<string>").alias("image_urls"))))
    found = value(spark, P.normalized_sources(sources, lit("https://r7.example/p")))
    assert len(found) == 20 and found[0]["url"] == "https://r7.example/p"
    specs = F.transform(F.sequence(lit(1), lit(110)), lambda i: F.struct(i.cast("string").alias("key"), lit("n").alias("name"), lit("v").alias("value")))
    assert len(value(spark, P.normalized_specifications(specs))) == 100


def test_marketplace_page(spark):
    assert value(spark, U.canonical_page(lit("https://www.amazon.co.uk/Name/dp/b0abcdefgh/ref=1"))) == "https://www.amazon.co.uk/dp/B0ABCDEFGH"


def test_json_fields_keep_the_rest(spark):
    out = value(spark, P.with_fields(lit('{"max_clicks": 3, "wait_ms": 700}'), "recipe", max_clicks=lit(5)))
    assert '"max_clicks":5' in out and '"wait_ms":700' in out
    assert value(spark, P.parsed(lit("nonsense"), "recipe")["max_clicks"]) is None


def test_letters_are_translated_at_once(spark):
    from vitrine.functions import text as T

    every = "".join(T._CYRILLIC) + T._MARKED + "Щъёь ß x9"
    plain = "".join(dict(zip(T._MARKED, T._PLAIN), **T._CYRILLIC).get(c, c) for c in every.lower())
    rows = spark.createDataFrame([(every,)], "t string").select(T.to_ascii(F.col("t")).alias("t"))
    assert rows.first()[0] == plain
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("replace(") <= sum(len(v) > 1 for v in T._CYRILLIC.values()) + 1


def test_a_draft_is_parsed_once_a_row(spark):
    import __spark_entry__ as engine

    plan = engine.queries()["draft_payloads"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "RepartitionByExpression [p_partkey" in plan
    plan = engine.queries()["approved_values"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan
