"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block quotas.

Documents are hashed (id and text) and every source is cut into blocks of equal hash ranges, its
share of about ``blocks`` in all, by its number of documents. A source's target in words gives whole
passes over its blocks and one pass over part of them, so its quota of blocks is exact.
A tree halves the output shards again and again; at each node the quotas of all sources are split
by a multivariate hypergeometric draw, one hypergeometric draw a source by inversion of its
distribution. Leaves hold how many blocks of each source a shard gets; every pass permutes the
blocks by hash, shards take consecutive, disjoint stretches of that order, and within a shard the
documents have a shuffled order by hash. All draws are hashes of ``seed``, so reruns agree.

The last, partial block of a source gives its documents in hash order up to the one that comes
nearest to the target. So what the mix takes of a document follows from its source and its hash: ``mixed`` reads the
plan, at most a row for each block, beside the texts, which are neither shuffled nor sorted. It does not write
shards: write its rows by ``mix_shard`` and sort by ``mix_order`` within it (``write_shards``).

Main path: DataFrame functions only. Tables of sources (a row each) pass through one task, for their
order and the tree; a partial block, the documents of one source over its number of blocks, is sorted in one.

Cases: a null source is a source of its own, ranked last; a null or empty text has size 0 and is
taken 0 words; a source without words has target 0; an empty table gives an empty mix; repeated
rows, also those of one doc_id or none, are documents of their own, and where the cut parts equal rows as many of them are taken as are due; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import n_words, staged


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): rank, weight and target.

    Targets share ``budget`` times all sizes by weight and stop at ``max_repeats`` times their
    source's size; the excess is shared again by weight. In the order of cap over weight, all
    sources up to some place are at their cap and those after it share the rest.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    rest = F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = capped.withColumn("level", rest / F.sum("weight").over(after))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), "level"))
    settled = level.withColumn("free", F.min(free).over(whole))
    target = F.least("cap", F.coalesce(F.col("free.level") * F.col("weight"), F.col("cap")))
    return settled.select("source", "source_size", "rank", "weight", target.alias("target"))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``total`` are among the ``good``, by inversion at ``u`` in [0, 1).

    Sums run over the support, cut 12 standard deviations around the mean, where what is left out
    is below the precision of a double.
    """
    low, high = F.greatest(F.lit(0).cast("long"), draws + good - total), F.least(good, draws)
    share = good / F.greatest(total, F.lit(1))
    mean = draws * share
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - share) * (total - draws) / F.greatest(total - 1, F.lit(1))))
    first = F.greatest(low, F.floor(mean - 12 * sd).cast("long") - 1)
    last = F.least(high, F.ceil(mean + 12 * sd).cast("long") + 1)
    values = F.sequence(first, F.greatest(first, last))

    def ratio(k: Column) -> Column:
        """Probability of k + 1 over that of k; 0 above the support."""
        return F.greatest(F.lit(0.0), ((good - k) * (draws - k)).cast("double")) / F.greatest(F.lit(1.0), ((k + 1) * (total - good - draws + k + 1)).cast("double"))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
    mass = F.aggregate(values, start, lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"]).alias("s")), lambda a: a["s"])
    begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), first.alias("k"))
    return F.aggregate(
        values, begin,
        lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["s"] + a["w"]).alias("s"), F.when(a["s"] <= u * mass, k).otherwise(a["k"]).alias("k")),
        lambda a: a["k"],
    )


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on ``key`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(2**53))


#: sources in one array of the tree, so that appending to it stays cheap
CHUNK = 256


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, shard, quota) from (rank, quota), ranks being 0, 1, ...: the leaves of the tree, each with its blocks of every source.

    A node's quotas are arrays of ``CHUNK`` sources in one array.
    """
    chunk = F.floor(F.col("rank") / CHUNK)
    chunks = quotas.groupBy(chunk.alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("quota"))
    arrays = chunks.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "quota"))), lambda x: x["quota"]).alias("quota"))
    nodes = arrays.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quota")
    zero = F.lit(0).cast("long")
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        middle = (F.col("lo") + F.col("hi")).cast("int") / 2
        total = F.aggregate("quota", zero, lambda a, c: a + F.aggregate(c, zero, lambda b, q: b + q))
        split = nodes.withColumn("mid", F.ceil(middle).cast("int")).withColumn("total", total)
        share = F.floor(F.col("total") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        state = lambda total, draws, i, left: F.struct(total.alias("total"), draws.alias("draws"), i.alias("i"), left.alias("left"))
        once = lambda x, use: F.transform(F.array(x), use)[0]  # noqa: E731  what is used several times is worked out once

        def draw(a: Column, q: Column) -> Column:
            k = F.when(a["draws"] == 0, zero).otherwise(hypergeometric(q, a["total"], a["draws"], uniform(F.lit(seed), F.col("lo"), F.col("hi"), a["i"])))
            return once(k, lambda x: state(a["total"] - q, a["draws"] - x, a["i"] + 1, F.concat(a["left"], F.array(x))))

        def draw_chunk(a: Column, c: Column) -> Column:
            inner = F.aggregate(c, state(a["total"], a["draws"], a["i"], F.array().cast("array<bigint>")), draw)
            return once(inner, lambda x: state(x["total"], x["draws"], x["i"], F.concat(a["left"], F.array(x["left"]))))

        begin = state(F.col("total"), share, F.lit(0), F.array().cast("array<array<bigint>>"))
        left = split.withColumn("left", F.aggregate("quota", begin, draw_chunk, lambda a: a["left"]))
        right = F.zip_with("quota", "left", lambda c, d: F.zip_with(c, d, lambda q, x: q - x))
        one = F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("quota"))
        two = F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), right.alias("quota"))
        nodes = left.select(F.explode(F.when(F.col("hi") - F.col("lo") <= 1, F.array(F.struct("lo", "hi", "quota"))).otherwise(F.array(one, two))).alias("n")).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), F.posexplode(F.flatten("quota")).alias("rank", "quota"))


def _hash(seed: int) -> Column:
    """A document's hash, from 0 up to 1."""
    return uniform(F.lit(seed), F.col("doc_id").cast("long"), F.col("text"))


class Plan:
    """What the mix takes of each source and hash.

    ``sizes``: doc_id, source, size and __u of every document; ``sources``: source, rank, source_size, target, __blocks;
    ``blocks``: __rank, __block, __passes, __last and the shards of its copies; ``cuts``: __rank, the hash up to which the partial
    block is taken (__cut), and how many of the documents at that hash (__due of __ties).
    """

    def __init__(self, sizes: DataFrame, sources: DataFrame, blocks: DataFrame, cuts: DataFrame) -> None:
        self.sizes, self.sources, self.blocks, self.cuts = sizes, sources, blocks, cuts

    def applied(self, rows: DataFrame, ties: DataFrame | None = None) -> DataFrame:
        """``rows``, which have source and __u, with the plan's columns and __shards, an entry for each copy.

        ``ties`` gives the rows at the cuts that have equal ones, with their number __tie among them; without it all
        documents of a cut are told apart by their hashes.
        """
        own = self.sources.select(F.col("source").alias("__source"), F.col("rank").alias("__rank"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__blocks")
        joined = rows.join(own, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__block", F.floor(F.col("__u") * F.col("__blocks")).cast("int"))
        joined = joined.join(self.blocks, ["__rank", "__block"]).join(self.cuts, ["__rank"], "left")
        below = (F.col("__u") < F.col("__cut")) | ((F.col("__u") == F.col("__cut")) & (F.col("__tie") <= F.col("__due")))
        extra = F.col("__last") & F.coalesce((F.floor(F.col("__cut") * F.col("__blocks")).cast("int") != F.col("__block")) | below, F.lit(True))
        joined = joined.withColumn("__extra", extra)
        copies = F.filter("__copies", lambda c: (c["copy"] < 2) | F.col("__extra"))
        return joined.withColumn("__shards", F.transform(copies, lambda c: c["shard"])).withColumn("__taken", F.col("__passes") + F.col("__extra").cast("int"))


def plan(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, max_repeats: float = 2.0, shards: int = 16, blocks: int | None = None, seed: int = 20) -> Plan:
    """The plan of a mix. ``blocks`` is a power of two from 1,024 to 65,536 unless given, one for about a thousand documents."""
    sizes = staged(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), _hash(seed).alias("__u")), "sizes")
    per_source = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "sources")
    total = per_source.agg(F.sum("docs")).first()[0] or 0
    blocks = blocks or 1 << min(16, max(10, (total // 1000).bit_length()))
    wanted = targets(per_source.select("source", "source_size"), weights, budget, max_repeats)
    joined = wanted.join(per_source.select(F.col("source").alias("__s"), "docs"), wanted["source"].eqNullSafe(F.col("__s"))).drop("__s")
    passes = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    sources = staged(joined.withColumns({"__blocks": F.ceil(F.col("docs") * blocks / max(1, total)).cast("int"), "__passes": passes, "__rest": F.col("target") - passes * F.col("source_size")}), "targets")

    own = Window.partitionBy("rank")
    placed = sizes.join(sources.select(F.col("source").alias("__s"), "rank", "__blocks"), F.col("source").eqNullSafe(F.col("__s")))
    placed = placed.withColumn("block", F.floor(F.col("__u") * F.col("__blocks")).cast("int"))
    filled = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"))
    known = filled.join(sources.select("rank", F.col("__passes").alias("passes"), F.col("__rest").alias("rest")), "rank")
    ordered = known.withColumn("n_blocks", F.count(F.lit(1)).over(own))
    for name, salt in (("p0", 0), ("p1", 1)):
        ordered = ordered.withColumn(name, F.row_number().over(own.orderBy(F.xxhash64(F.lit(seed + salt), "rank", "block"), "block")) - 1)
    # the last pass follows the order p<passes>; of the words before a block depends whether it is taken
    ordered = ordered.withColumn("p_last", F.when(F.col("passes") == 0, F.col("p0")).otherwise(F.col("p1")))
    before = F.coalesce(F.sum("words").over(own.orderBy("p_last").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.lit(0.0), F.least(F.col("words").cast("double"), F.col("rest") - F.col("before")))
    # blocks of the last pass are the first ones of its order, those without a word among them
    cut = staged(ordered.withColumn("before", before).withColumns({"part": part, "last": F.col("before") < F.col("rest")}), "blocks")

    per_rank = cut.groupBy("rank").agg((F.first("passes") * F.first("n_blocks") + F.count_if("last")).alias("quota"))
    leaves = splitting_tree(per_rank, shards, seed)
    stretch = leaves.withColumn("end", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard"))).where("quota > 0")
    dealt = stretch.select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("draw"))
    # draws of a block: whole passes 0 and 1, then the partial one
    draw = lambda test, copy, at: F.when(test, F.array(F.struct(F.lit(copy).alias("copy"), at.cast("long").alias("draw")))).otherwise(F.array())
    draws = F.concat(draw(F.col("passes") >= 1, 0, F.col("p0")), draw(F.col("passes") >= 2, 1, F.col("n_blocks") + F.col("p1")), draw(F.col("last"), 2, F.col("passes") * F.col("n_blocks") + F.col("p_last")))
    drawn = cut.select("rank", "block", F.explode(draws).alias("d")).select("rank", "block", "d.copy", "d.draw")
    shard_of = drawn.join(dealt, ["rank", "draw"]).groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("copies"))
    per_block = cut.join(shard_of, ["rank", "block"], "left").select(
        F.col("rank").alias("__rank"), F.col("block").alias("__block"), F.col("passes").alias("__passes"), F.col("last").alias("__last"),
        F.coalesce("copies", F.array().cast("array<struct<copy:int,shard:int>>")).alias("__copies"))

    # of the partly taken block of a source, documents in hash order: one is taken if its middle lies below the cut
    partial = cut.where(F.col("last") & (F.col("part") < F.col("words"))).select("rank", "block", "part")
    inside = Window.partitionBy("rank").orderBy("__u", "size").rowsBetween(Window.unboundedPreceding, -1)
    cutting = placed.join(partial, ["rank", "block"]).withColumn("taken", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2 <= F.col("part"))
    ends = cutting.groupBy("rank", "__u").agg(F.count_if("taken").alias("due"), F.count(F.lit(1)).alias("ties"))
    # the last hash of which something is taken; -1 takes nothing of the block
    at = ends.where("due > 0").groupBy("rank").agg(F.max(F.struct("__u", "due", "ties")).alias("at"))
    nothing = (partial.join(sources.select("rank", "__blocks"), "rank").select(F.col("rank").alias("__rank"), (F.col("block") / F.col("__blocks")).alias("__none")))
    cuts = nothing.join(at.withColumnRenamed("rank", "__rank"), "__rank", "left").select("__rank", F.coalesce("at.__u", "__none").alias("__cut"), F.coalesce("at.due", F.lit(0)).alias("__due"), F.coalesce("at.ties", F.lit(0)).alias("__ties"))
    return Plan(sizes, sources.select("source", "rank", "source_size", "target", "__blocks"), staged(per_block, "block_plan"), staged(cuts, "cuts"))


def _tied(rows: DataFrame, found: Plan, order: Column) -> DataFrame:
    """``rows`` (with source and __u) with __tie, the number of a row among those of its source and hash where a cut parts them, else 1."""
    parted = found.cuts.where("__due < __ties AND __due > 0")
    if parted.isEmpty():  # a row for each source
        return rows.withColumn("__tie", F.lit(1))
    at = parted.join(found.sources.select(F.col("rank").alias("__rank"), F.col("source").alias("__s")), "__rank").select("__s", F.col("__cut").alias("__at"))
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("__u") == F.col("__at"))
    equal = rows.join(at, same).drop("__s", "__at").withColumn("__tie", F.row_number().over(Window.partitionBy("source", "__u").orderBy(order)))
    return rows.join(at, same, "left_anti").withColumn("__tie", F.lit(1)).unionByName(equal)


def mix_plan(documents: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken words and the shards of its copies.

    A document that the mix takes twice has two shards. Options are those of :func:`plan`.
    """
    found = plan(documents, **options)
    rows = found.applied(_tied(found.sizes, found, F.col("size")))
    return rows.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__taken")).cast("long").alias("taken"), F.col("__shards").alias("shards"))


def mixed(documents: DataFrame, shards: int = 16, seed: int = 20, **options) -> DataFrame:
    """The mix itself: a row for each copy of a document with ``mix_copy``, ``mix_shard`` and ``mix_order``, its hash order within the shard.

    Columns that already have one of the three names are replaced.
    """
    documents = documents.drop("mix_copy", "mix_shard", "mix_order")
    found = plan(documents, shards=shards, seed=seed, **options)
    keyed = documents.withColumn("__u", _hash(seed))
    rows = found.applied(_tied(keyed, found, F.xxhash64(*documents.columns)))
    out = rows.select(*documents.columns, "__u", F.posexplode("__shards").alias("mix_copy", "mix_shard"))
    return out.withColumn("mix_order", F.xxhash64(F.lit(seed), "__u", "mix_copy", "mix_shard")).drop("__u")


def write_shards(mix: DataFrame, path: str) -> None:
    """The rows of :func:`mixed` as Parquet, a folder for each shard and sorted by ``mix_order`` within its files."""
    mix.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)
