"""References, redirects, exclusions, polling and counts beside a result."""

import json
import os
import random

from pyspark.sql import functions as F

from vitrine.operators import references as R
from vitrine.operators.exclusions import Exclusions
from vitrine.sources import polling
from vitrine.streaming import intake


def test_targets_by_type_and_id(spark, tmp_path):
    spark.createDataFrame([(1, "lamp"), (2, None)], "id long, name string").write.parquet(f"{tmp_path}/products")
    spark.createDataFrame([(1, 5)], "id long, n int").write.parquet(f"{tmp_path}/drafts")
    targets = {t: spark.read.parquet(f"{tmp_path}/{t}") for t in ("products", "drafts")}
    rows = [(1, "products", 1), (2, "products", 2), (3, "products", 9), (4, "other", 1), (5, None, 1), (6, "products", None), (7, "products", 1)]
    found = R.resolved(spark.createDataFrame(rows, "op long, target_type string, target_id long"), targets)
    assert {r.op: json.loads(r.target) if r.target else None for r in found.collect()} == {1: {"id": 1, "name": "lamp"}, 2: {"id": 2}, 3: None, 4: None, 5: None, 6: None, 7: {"id": 1, "name": "lamp"}}
    files = {os.path.dirname(f).split("/")[-1] for f in found.inputFiles()}
    assert files == {"products"}  # no row refers to a draft
    assert R.resolved(spark.createDataFrame([], "op long, target_type string, target_id long"), targets).columns == ["op", "target_type", "target_id", "target"]


def walked(url, responses, most=3):
    for hops in range(most + 1):
        if "//10." in url or not url.startswith("http"):
            return url, hops, "blocked"
        if url not in responses:
            return url, hops, "missing"
        status, location = responses[url]
        if not 300 <= status < 400:
            return url, hops, "failed" if status >= 400 else None
        if not location:
            return url, hops, "no_location"
        if hops == most:
            return url, hops, "too_many"
        url = location if "://" in location else "https:" + location if location.startswith("//") else "/".join(url.split("/")[:3]) + location


def test_redirects_by_brute_force(spark):
    rnd = random.Random(1)
    urls = [f"https://a{i}.example/x{i}" for i in range(60)]
    places = [*urls, "https://10.0.0.1/", "ftp://f.example/", "//a1.example/x1", "/y", "", None, "https://gone.example/"]
    responses = {u: (rnd.choice([301, 302, 307, 200, 404]), rnd.choice(places)) for u in urls}
    responses |= {urls[0]: (301, urls[0]), urls[1]: (302, urls[2]), urls[2]: (302, urls[1]), urls[3]: (301, urls[4]), urls[4]: (301, urls[5]), urls[5]: (301, urls[6]), urls[6]: (200, None)}
    asked = [(i, u) for i, u in enumerate([*urls, *urls[:5], "https://10.1.1.1/", "https://none.example/"])]
    found = R.redirected(spark.createDataFrame(asked, "id long, url string"), spark.createDataFrame([(u, *r) for u, r in responses.items()], "url string, status int, location string")).collect()
    assert {r.id: (r.final_url, r.hops, r.refused) for r in found} == {i: walked(u, responses) for i, u in asked} and len(found) == len(asked)
    assert walked(urls[3], responses) == (urls[6], 3, None) and walked(urls[0], responses)[2] == "too_many"


def test_last_page_before_a_pick_wins(spark, tmp_path):
    rnd = random.Random(2)
    finds = [(rnd.choice("uvw"), f"p{rnd.randrange(30)}", rnd.randrange(0, 400) * 3600) for _ in range(150)]
    picks = [(i, rnd.choice("uvwx"), rnd.randrange(0, 400) * 3600) for i in range(80)]
    at = lambda c: F.timestamp_seconds(F.col(c) + 86_400 * 365)
    spark.createDataFrame(finds, "url string, page string, t long").select("url", "page", at("t").alias("found_at")).write.parquet(f"{tmp_path}/finds")
    spark.createDataFrame(picks, "pick_id long, url string, t long").select("pick_id", "url", at("t").alias("picked_at")).write.parquet(f"{tmp_path}/picks")
    stream = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}")
    found = {r.pick_id: r.page for r in R.pages_of_picks(stream("finds"), stream("picks"), "2 days").collect()}
    want = {}
    for i, url, t in picks:
        near = [(x, page) for u, page, x in finds if u == url and x <= t < x + 2 * 86_400]
        if near:
            want[i] = max(near)[1]
    assert found == want and 0 < len(want) < 80


def test_counts_come_with_the_rows(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.col("id") % 7)
    kept, seen = R.with_diagnostics(rows.where("v < 3"), "t", n=F.count(F.lit(1)), top=F.max("id"), zeros=F.count_if(F.col("v") == 0))
    assert seen.collect()[0].asDict() == {"n": 44, "top": 99, "zeros": 15} and kept.count() == 44


def test_exclusions_add_up_once(spark, tmp_path):
    kept = Exclusions(spark, f"{tmp_path}/x")
    assert kept.rows().count() == 0
    addresses = spark.createDataFrame([(1, "image", " https://a/1.jpg "), (1, "image", "https://a/1.jpg"), (1, "source", "https://a"), (2, "source", ""), (2, "odd", "z"), (None, "image", "q"), (2, "image", None)], "draft_id int, kind string, value string")
    hashes = spark.createDataFrame([(1, 0, 0), (1, None, 0)], "draft_id long, high long, low long")
    for _ in range(2):
        kept.add("1", addresses, hashes)
        assert sorted(map(tuple, kept.rows().select("draft_id", "kind", "value").collect()), key=str) == [(1, "hash", None), (1, "image", "https://a/1.jpg"), (1, "source", "https://a")]
    kept.add("2", spark.createDataFrame([(1, "image", "https://a/1.jpg"), (3, "image", "https://c/3.jpg")], "draft_id int, kind string, value string"))
    small = kept.compact(f"{tmp_path}/y")
    assert sorted(map(tuple, small.rows().collect()), key=str) == sorted(map(tuple, kept.rows().collect()), key=str) and kept.rows().count() == 4
    candidates = spark.createDataFrame([(1, "https://a/1.jpg", None), (1, "https://b/2.jpg", "https://a "), (1, "https://b/3.jpg", "https://b"), (2, "https://a/1.jpg", "https://a"), (None, "https://a/1.jpg", "https://a"), (1, None, None)], "draft_id long, url string, page string")
    assert sorted(((r.draft_id, r.url) for r in kept.allowed(candidates).collect()), key=str) == sorted([(1, "https://b/3.jpg"), (2, "https://a/1.jpg"), (None, "https://a/1.jpg"), (1, None)], key=str)
    images = spark.createDataFrame([(1, 0, 0, 7), (1, 1, 0, 2**20 - 1), (1, 2, 0, 2**20 - 2), (2, 0, 0, 7)], "draft_id long, pos int, high long, low long")
    assert sorted((r.draft_id, r.pos) for r in kept.chosen(images).collect()) == [(1, 1), (2, 0)]


def test_polling_goes_on_behind_its_offset(spark, tmp_path):
    folder, out = f"{tmp_path}/readings", f"{tmp_path}/out"

    def poll():
        intake.polled(polling.readings(spark, folder), out, "changes", interval=None).awaitTermination()
        rows = spark.read.schema("name string, value string, at long, batch long").parquet(f"{out}/changes")
        return sorted((r["at"], r["name"], r["value"]) for r in rows.collect())

    polling.add_reading(folder, 1, [("proxy", "https://a", 1), ("other", None, 1)])
    polling.add_reading(folder, 2, [("proxy", "https://a", 2)])
    first = [(1, "other", None), (1, "proxy", "https://a")]
    assert poll() == first
    assert poll() == first  # nothing new
    polling.add_reading(folder, 3, [("proxy", "https://a", 3), ("other", None, 3)])
    polling.add_reading(folder, 10, [("proxy", "https://b", 4), ("other", "x", 4)])
    assert poll() == [*first, (4, "other", "x"), (4, "proxy", "https://b")]
    polling.add_reading(folder, 11, [("proxy", "https://b", 5), ("proxy", "https://a", 6)])
    assert poll()[-1] == (6, "proxy", "https://a")
    done = open(f"{folder}/{polling.DONE}").read()
    assert "0000000002.jsonl" <= done < "0000000011.jsonl"  # a batch is known to be done once the next one is planned
    for name in os.listdir(folder):  # their maker may delete those
        if name <= done:
            os.remove(f"{folder}/{name}")
    polling.add_reading(folder, 12, [("proxy", "https://c", 7)])
    assert poll()[-1] == (7, "proxy", "https://c") and len(poll()) == 6
