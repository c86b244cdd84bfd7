"""Choosing pictures: review acceptance, ordering, best per asset, near-duplicate and exact-duplicate removal."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.numbers import greedy_distinct, hamming
from vitrine.functions.urls import asset_key


def accepted(color_wanted: Column, supported: Column, least: int = 60) -> Column:
    """Whether a review lets a picture through: publishable, right colour, a photo of the product, good enough, and exact or supported by its source."""
    return F.coalesce(F.col("publishable") & (~color_wanted | F.col("color_match")) & F.col("kind").isin("product", "packaging", "detail") & (F.col("score") >= least) & (F.col("exact_match") | supported), F.lit(False))


def review_order() -> list[Column]:
    """Front views first, then exact, supported, product photos and the score; input order settles ties."""
    hero = ((F.col("kind") == "product") & (F.col("view") == "front")).cast("int")
    return [hero.desc(), F.col("exact_match").desc(), F.col("supported").desc(), (F.col("kind") == "product").desc(), F.col("score").desc(), F.col("index")]


def gallery_order() -> list[Column]:
    """The reviewer's own ranking, then the score."""
    return [F.col("gallery_rank").asc_nulls_last(), F.col("score").desc(), F.col("index")]


def reviewed(candidates: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Candidates with their review, by place within their batch (reviews count from 1)."""
    placed = candidates.withColumn("index", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    return placed.join(reviews, [key, "index"])


def best_per_key(rows: DataFrame, keys: list[str], score: str, pos: str) -> DataFrame:
    """The highest score of each key, the first one among equals; ``first_pos`` is where the key first appeared."""
    packed = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(score, -F.col(pos))).alias("__r"), F.min(pos).alias("first_pos"))
    return packed.select("__r.*", "first_pos")


def best_images(images: DataFrame, *keys: str) -> DataFrame:
    """The largest picture of each asset."""
    return best_per_key(images.withColumn("asset", asset_key(F.col("url"))), [*keys, "asset"], "quality", "pos")


def best_partial(galleries: DataFrame, key: str) -> DataFrame:
    """The gallery with most pictures of each key; the first among equals. ``all_partial`` tells if none was complete."""
    return galleries.groupBy(key).agg(F.max_by("gallery", F.struct("n_images", -F.col("pos"))).alias("gallery"), F.max("n_images").alias("n_images"), F.bool_and("partial").alias("all_partial"), F.bool_or("partial").alias("any_partial"))


def exact_distinct(rows: DataFrame, content: str, pos: str, *keys: str) -> DataFrame:
    """The first row of each content by SHA-256; texts do not travel, only digests and places."""
    digest = F.sha2(F.col(content), 256)
    first = rows.select(*keys, pos, digest.alias("sha256")).groupBy(*keys, "sha256").agg(F.min(pos).alias(pos), F.count(F.lit(1)).alias("copies"))
    return first


def without_near_duplicates(images: DataFrame, key: str, excluded: DataFrame | None = None, most: int = 6) -> DataFrame:
    """Pictures (key, pos, high, low) of each key, first kept wins, that are farther than ``most`` bits from all kept before.

    Meant for the pictures of one product, which are few; for pairs over a whole collection see :func:`near_pairs`.
    """
    lists = images.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "high", "low"))).alias("__a"))
    if excluded is not None:
        lists = lists.join(excluded.groupBy(key).agg(F.collect_list(F.struct(F.lit(-1).alias("pos"), "high", "low")).alias("__x")), key, "left")
        banned = F.coalesce("__x", F.array().cast("array<struct<pos:int,high:bigint,low:bigint>>"))
        kept = greedy_distinct(F.col("__a"), banned, most)
    else:
        kept = greedy_distinct(F.col("__a"), None, most)
    return lists.select(key, F.explode(kept).alias("__k")).select(key, "__k.*")


def hash_members(hashes: DataFrame) -> DataFrame:
    """(id, representative, copies) of every row of hashes (id, high, low): the lowest id with the same hash, and how many rows have it.

    Joined to :func:`near_pairs` on both sides, it gives the pairs of all rows; rows with one representative are 0 bits apart.
    """
    nodes = hashes.groupBy("high", "low").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("copies"))
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("high", "low")]
    return hashes.alias("h").join(nodes.alias("n"), same).select("h.id", "n.representative", "n.copies")


def near_pairs(hashes: DataFrame, most: int = 6, block: int = 512) -> DataFrame:
    """(a, b, distance) of all different hashes (id, high, low) at most ``most`` bits apart, each under its lowest id.

    By the pigeonhole principle, two 64-bit hashes within ``most`` bits agree in one of ``most`` + 1
    chunks, and in two of ``most`` + 2; only hashes that share a chunk, or two where that takes at most 100 keys,
    are compared. The nodes of a key with more than ``block`` are split into blocks that are compared
    pair by pair, so no task holds a large key. Equal hashes are one node, so a group of
    copies is compared once; :func:`hash_members` has its members.
    """
    joint = 2 if (most + 2) * (most + 1) // 2 <= 100 else 1
    chunks = most + joint
    bits = F.concat(F.lpad(F.bin("high"), 32, "0"), F.lpad(F.bin("low"), 32, "0"))
    edges = [i * 64 // chunks for i in range(chunks + 1)]
    chunk = lambda i: F.substring(bits, 1 + edges[i], edges[i + 1] - edges[i])
    nodes = hashes.groupBy("high", "low").agg(F.min("id").alias("id"))
    keyed = nodes.withColumn("__chunk", F.explode(F.array(*[F.concat(F.lit(":".join(map(str, c)) + ":"), *map(chunk, c)) for c in combinations(range(chunks), joint)])))
    sizes = keyed.groupBy("__chunk").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__blocks"))
    placed = keyed.join(sizes.where("__blocks > 1"), "__chunk", "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    placed = placed.withColumn("__block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int"))
    # a node goes to the pairs of its own block with every block of its key
    celled = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    node = F.struct("id", "high", "low", F.col("__block").alias("block"))
    cell = [F.least("__block", "__other").alias("__low"), F.greatest("__block", "__other").alias("__high")]
    a, b = celled.select("__chunk", *cell, node.alias("a")), celled.select("__chunk", *cell, node.alias("b"))
    d = hamming(F.col("a"), F.col("b"))
    once = (F.col("a.block") != F.col("b.block")) | (F.col("__low") == F.col("__high"))
    return a.join(b, ["__chunk", "__low", "__high"]).where(once & (F.col("a.id") < F.col("b.id"))).withColumn("distance", d).where(F.col("distance") <= most).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "distance").distinct()


def candidates_by_asset(dom: DataFrame, candidates: DataFrame, priority: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Candidates of each page: two priority pictures or more alone; else, with two in the gallery, all that share an asset with it; else all. Assets of videos and turntables are out."""
    off = media.select(key, asset_key(F.col("url")).alias("__asset")).distinct()
    left = candidates.withColumn("__asset", asset_key(F.col("url"))).join(off, [key, "__asset"], "left_anti")
    n_priority = priority.groupBy(key).agg(F.count(F.lit(1)).alias("__p"))
    n_dom = dom.groupBy(key).agg(F.count(F.lit(1)).alias("__d"))
    in_dom = dom.select(key, asset_key(F.col("url")).alias("__asset"), F.lit(True).alias("__in_dom")).distinct()
    in_priority = priority.select(key, asset_key(F.col("url")).alias("__asset"), F.lit(True).alias("__in_priority")).distinct()
    joined = left.join(n_priority, key, "left").join(n_dom, key, "left").join(in_dom, [key, "__asset"], "left").join(in_priority, [key, "__asset"], "left")
    rule = F.when(F.coalesce("__p", F.lit(0)) >= 2, F.col("__in_priority").isNotNull()).when(F.coalesce("__d", F.lit(0)) >= 2, F.col("__in_dom").isNotNull()).otherwise(True)
    return joined.where(rule).select(*candidates.columns)
