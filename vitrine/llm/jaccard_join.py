"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles (A-Z lower-cased; a text of one to four words is one
shingle). Documents with equal sets form a class and are joined once. Each class has a signature of
minimum hashes; a run starts by splitting all classes by one position of it. A bucket of more than
``bucket`` classes is split again by a position its path chooses, in a quarter of the cases by two
(1.25 = 1 / 0.8 on average, so a pair at the threshold is expected to stay together), up to
``depth`` times, unless its signatures agree so far that it is one group of near copies; what
stays larger is compared block by block, every block pair a task of its own, leaving out what
another large bucket compares. Small buckets are brute-forced: exact intersections by a matrix product. Runs are
repeated until ``target_recall``: a pair at similarity s that meets d positions on its way is missed by a share of
about (1 - s ** d) ** runs, and ``runs_for`` gives the runs that hold this at the threshold for pairs whose buckets
split ``depth`` times, the most there are. With 13 runs a pair at 0.8 is missed in one of a billion cases by its first
position alone, in six of a million where that bucket is split once more.

A pair may meet in several buckets. Every class carries the list of its buckets, and a pair counts
in the first one it shares; so no table of pairs is ever written, and dense groups cost comparisons
but not rows: a bucket returns a row for each class with a link - its component within the bucket
and its number of linked documents. Components over buckets come from star contraction.

Node ids are 64-bit hashes of shingle sets.

Cases: null or empty text (no word) has no links and is its own class; equal sets (also of repeated
rows) link each with each; ties do not arise, as class ids are the lowest doc_id; a row without a doc_id is joined as all
others, and a class of such rows alone has a null class id; rows of one doc_id with different texts are documents
of their own; other columns are not read by ``classes``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import doc_slices, mixed_bits, small_batches, staged, word_hashes

POSITIONS = 32
_RNG = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RNG.integers(1, 2**63, POSITIONS, dtype=np.uint64) | np.uint64(1)
_ADDENDS = _RNG.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_WORD_FACTORS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    size = max(0, len(words) - n + 1)
    whole = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        whole += words[j : j + size] * _WORD_FACTORS[j]
    whole = mixed_bits(whole)
    out = []
    for end, count in zip(ends, counts):
        if count >= n:
            out.append(np.unique(whole[end - count : end - n + 1]))
        elif count:
            short = words[end - count : end] * _WORD_FACTORS[n : n + count]
            out.append(mixed_bits(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(count)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_id(shingles: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(shingles.tobytes()), dtype="<i8")[0])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set, as 32-bit numbers."""
    out = np.empty(POSITIONS, dtype=np.uint64)
    for i in range(POSITIONS):
        out[i] = (shingles * _FACTORS[i] + _ADDENDS[i]).min()
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text) and text: together the first two tell rows apart as far as need be."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def signatures(documents: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, th, node, sig) of every document; ``node`` and ``sig`` are null without a word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_slices(batches, 2_000_000):
            sets = shingle_sets([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()], n)
            nodes = [set_id(s) if len(s) else None for s in sets]
            sigs = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "th", "node", "sig"])

    return keyed(documents).mapInArrow(sign, "doc_id long, th long, node long, sig array<int>")


def runs_for(target_recall: float, threshold: tuple[int, int], depth: int) -> int:
    """The runs after which a pair at the threshold, its buckets split ``depth`` times, has met in one with probability ``target_recall``."""
    together = (threshold[0] / threshold[1]) ** (1 + 1.25 * (depth - 1))
    runs = max(1, math.ceil(math.log(1 - target_recall) / math.log(1 - together)))
    if runs > POSITIONS:
        raise ValueError(f"a recall of {target_recall} takes {runs} runs; there are {POSITIONS} positions to begin one")
    return runs


def _counted(paths: DataFrame) -> DataFrame:
    """``paths`` (path, node) that more than one node is on, with their number."""
    counts = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return paths.join(counts, "path")


def _position(i: Column) -> Column:
    return F.element_at("sig", i.cast("int") + 1)


def _dense(large: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Paths whose classes agree with one of them in a share of ``least`` of the signature, on average: splitting would not part them.

    About 64 classes of a path, chosen by hash, stand for it; the answer decides how the path is
    worked on, not what is found.
    """
    chosen = large.where(F.pmod(F.xxhash64("path", "node"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / 64))) == 0)
    signed = chosen.select("path", "node").join(nodes.select("node", "sig"), "node")
    pivots = signed.groupBy("path").agg(F.min_by("sig", "node").alias("pivot"))
    agree = F.size(F.filter(F.zip_with("sig", "pivot", lambda a, b: a == b), lambda x: x)) / POSITIONS
    return signed.join(pivots, "path").groupBy("path").agg(F.avg(agree).alias("agree")).where(F.col("agree") >= least).select("path")


def leaves(nodes: DataFrame, bucket: int, depth: int, runs: int, dense: float = 0.5) -> DataFrame:
    """(path, node, size): the buckets that the chosen paths end in."""
    first = nodes.select("node", F.posexplode(F.slice("sig", 1, runs)).alias("run", "v")).select(F.xxhash64("run", "v").alias("path"), "node")
    level = staged(_counted(first), "paths")
    done = level.where(F.col("size") <= bucket)
    for step in range(1, depth):
        large = level.where(F.col("size") > bucket)
        if large.isEmpty():
            return done
        whole = staged(_dense(large, nodes, dense), f"dense_{step}")
        done = done.unionByName(large.join(whole, "path", "left_semi").select(*done.columns))
        large = large.join(whole, "path", "left_anti")
        one = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(POSITIONS))
        two = F.pmod(F.xxhash64("path", F.lit(2)), F.lit(POSITIONS))
        chosen = F.when(F.pmod(F.xxhash64("path", F.lit(3)), F.lit(4)) == 0, F.array_distinct(F.array(one, two))).otherwise(F.array(one))
        below = large.select("path", "node").join(nodes.select("node", "sig"), "node").select("path", "node", "sig", F.explode(chosen).alias("i")).select(F.xxhash64("path", "i", _position(F.col("i"))).alias("path"), "node")
        level = staged(_counted(below), f"paths_{step}")
        done = done.unionByName(level if step == depth - 1 else level.where(F.col("size") <= bucket))
    return done


def _blocked(large: DataFrame, block: int) -> DataFrame:
    """(path, node, fresh, blocks, block): large buckets cut into blocks that are compared pair by pair.

    Members whose lowest large path is one and the same other path have been compared there; the
    most frequent such group of a bucket gets blocks of its own, numbered from ``fresh`` on, which
    are compared with the first ``fresh`` blocks only.
    """
    own = large.groupBy("node").agg(F.min("path").alias("lowest"))
    marked = large.select("path", "node").join(own, "node")
    most = marked.where("lowest < path").groupBy("path", "lowest").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.max_by("lowest", F.struct("n", "lowest")).alias("most"))
    known = marked.join(most, "path", "left").withColumn("old", F.coalesce(F.col("lowest") == F.col("most"), F.lit(False)))
    sizes = known.groupBy("path").agg(F.count_if(~F.col("old")).alias("n_new"), F.count_if("old").alias("n_old"))
    sizes = sizes.select("path", F.ceil(F.col("n_new") / block).cast("int").alias("fresh"), F.ceil(F.col("n_old") / block).cast("int").alias("settled"))
    h = F.xxhash64("node", F.lit(11))
    number = F.when(F.col("old"), F.col("fresh") + F.pmod(h, F.greatest(F.col("settled"), F.lit(1)))).otherwise(F.pmod(h, F.greatest(F.col("fresh"), F.lit(1))))
    return known.join(sizes, "path").where("fresh > 0").select("path", "node", "fresh", (F.col("fresh") + F.col("settled")).alias("blocks"), number.cast("int").alias("block"))


def _links(sets: list[np.ndarray], lists: list[np.ndarray], here: int, rate: tuple[int, int], cross: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of linked pairs, and of those whose first shared bucket is ``here``.

    With ``cross``, only pairs of one of the first ``cross`` sets and one of the others count.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    values, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    shared = times[inverse] > 1
    common = np.zeros((n, n), dtype=np.int64)
    width = int((times > 1).sum())
    place, who = column[inverse[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, who = place[order], who[order]
    for start in range(0, width, 8192):
        a, b = np.searchsorted(place, [start, start + 8192])
        matrix = np.zeros((n, min(8192, width - start)), dtype=np.float32)
        matrix[who[a:b], place[a:b] - start] = 1
        common += np.rint(matrix @ matrix.T).astype(np.int64)
    num, den = rate
    linked = common * den >= num * (sizes[:, None] + sizes[None, :] - common)
    linked &= common > 0
    np.fill_diagonal(linked, False)
    if cross is not None:
        linked[:cross, :cross] = False
        linked[cross:, cross:] = False
    earlier = sorted({int(p) for x in lists for p in x if p < here})
    first = linked.copy()
    if earlier and linked.any():
        member = np.zeros((n, len(earlier)), dtype=np.float32)
        at = {p: k for k, p in enumerate(earlier)}
        for i, x in enumerate(lists):
            member[i, [at[int(p)] for p in x if p < here]] = 1
        first &= (member @ member.T) == 0
    return linked, first


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The lowest id of each node's component."""
    root = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], top).min(axis=1))
        if (new == root).all():
            return root
        root = new


def links(documents: DataFrame, nodes: DataFrame, paths: DataFrame, n: int, rate: tuple[int, int], bucket: int) -> DataFrame:
    """(node, root, weight): for every bucket and class with a link there, its component and its linked documents.

    Buckets with the same members are compared once.
    """
    small, large = paths.where(F.col("size") <= bucket), paths.where(F.col("size") > bucket)
    groups = small.groupBy("path").agg(F.sort_array(F.collect_list("node")).alias("members"))  # at most ``bucket`` members
    kept = groups.groupBy(F.xxhash64("members").alias("h"), F.size("members").alias("s"), F.col("members")[0].alias("m")).agg(F.min_by("members", "path").alias("members"), F.min("path").alias("path"))
    alone = [F.lit(1).alias("fresh"), F.lit(1).alias("blocks"), F.lit(0).alias("block")]
    tasks = kept.select("path", F.explode("members").alias("node"), *alone).unionByName(_blocked(large, 2 * bucket))
    lists = staged(tasks.groupBy("node").agg(F.collect_list(F.struct("path", "fresh", "blocks", "block")).alias("on")), "lists")
    wanted = lists.join(nodes.select("node", "rep", "copies"), "node").select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"), "node", "copies", "on")
    texts = keyed(documents).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))).select("text", "node", "copies", "on")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: set[int] = set()  # repeated rows come more than once
        for batch in doc_slices(batches, 1_000_000):
            rows: list[tuple] = []
            names = batch.schema.names
            sets = shingle_sets([t or b"" for t in batch.column(names.index("text")).cast(pa.binary()).to_pylist()], n)
            for shingles, node, copies, on in zip(sets, *(batch.column(names.index(c)).to_pylist() for c in ("node", "copies", "on"))):
                if node in dealt:
                    continue
                dealt.add(node)
                held = np.array(sorted({x["path"] for x in on}), dtype="<i8").tobytes()
                data = shingles.tobytes()
                for x in on:
                    # settled blocks have been compared with each other elsewhere
                    for other in range(x["blocks"] if x["block"] < x["fresh"] else x["fresh"]):
                        a, b = sorted((x["block"], other))
                        rows.append((x["path"], a, b, int(x["block"] != a), node, copies, held, data))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            for start in range(0, len(rows), 2000):
                part = rows[start : start + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(kinds)], names=["path", "a", "b", "side", "node", "copies", "held", "shingles"])

    dealt = texts.mapInArrow(deal, "path long, a int, b int, side int, node long, copies long, held binary, shingles binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[list[int]] = [[], [], []]

        def finish() -> None:
            seen, rows = set(), []
            for r in sorted(group, key=lambda r: r["side"]):
                if r["node"] not in seen:
                    seen.add(r["node"])
                    rows.append(r)
            if len(rows) < 2:
                return
            ids = np.array([r["node"] for r in rows], dtype=np.int64)
            copies = np.array([r["copies"] for r in rows], dtype=np.int64)
            cross = sum(r["side"] == 0 for r in rows) if rows[0]["a"] != rows[0]["b"] else None
            linked, first = _links([np.frombuffer(r["shingles"], dtype="<u8") for r in rows], [np.frombuffer(r["held"], dtype="<i8") for r in rows], rows[0]["path"], rate, cross)
            some = linked.any(axis=1)
            if some.any():
                root, weight = _roots(linked, ids), first @ copies
                for column, values in zip(out, (ids[some], root[some], weight[some])):
                    column += values.tolist()

        key = None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["path"], row["a"], row["b"]) != key:
                    finish()
                    group.clear()
                    key = (row["path"], row["a"], row["b"])
                group.append(row)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "root", "weight"])
                out = [[], [], []]
        finish()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "root", "weight"])

    return dealt.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b").mapInArrow(compare, "node long, root long, weight long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the lowest node of every node's component of (u, v) edges, by alternating star contraction."""
    e = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = staged(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _placed(documents: DataFrame, threshold: tuple[int, int] = (4, 5), n: int = 5, bucket: int = 512, depth: int = 4, target_recall: float = 0.995, runs: int | None = None) -> DataFrame:
    """(doc_id, th, class, class_rep, n_links, copy_rep) of every document: the class's node (null without a word), and of the class and of the set the first (none, doc_id, th)."""
    small_batches(documents.sparkSession)
    signed = staged(signatures(documents, n), "signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    nodes = staged(signed.where("node IS NOT NULL").groupBy("node").agg(rep.alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig")), "nodes")
    found = staged(links(documents, nodes, leaves(nodes, bucket, depth, runs or runs_for(target_recall, threshold, depth)), n, threshold, bucket), "links")
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    lowest = every.join(nodes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_rep"))
    placed = every.join(lowest, "root").select("node", "root", "class_rep")
    weights = found.groupBy("node").agg(F.sum("weight").alias("weight"))
    table = nodes.select("node", "rep", "copies").join(placed, "node", "left").join(weights, "node", "left")
    table = table.select("node", F.coalesce("root", "node").alias("class"), F.coalesce("class_rep", "rep").alias("class_rep"), F.col("rep").alias("copy_rep"), (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "th", "node").join(table, "node", "left").select("doc_id", "th", "class", "class_rep", "n_links", "copy_rep")


def classes(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links, copy_of) of every document.

    ``class_id`` is the lowest doc_id of the component of linked documents, ``n_links`` the number
    of documents at similarity ``threshold`` or more, ``copy_of`` the lowest doc_id with the same set. Options are
    ``threshold`` (a fraction), ``n`` (words a shingle), ``bucket``, ``depth``, ``target_recall`` and ``runs`` in its place.
    """
    alone = F.col("class").isNull()
    return _placed(documents, **options).select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_rep.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("copy_rep.doc_id")).alias("copy_of"))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with one row of each class, one with the lowest doc_id (rows without one come last); rows without a word all stay."""
    found = _placed(documents, **options).where("class IS NOT NULL")
    first = (F.col("doc_id").eqNullSafe(F.col("class_rep.doc_id"))) & (F.col("th") == F.col("class_rep.th"))
    rows = staged(found.select("doc_id", "th", first.alias("first")), "verdicts")
    key = [F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__th")]
    same = F.col("__id").eqNullSafe(F.col("doc_id_")) & (F.col("__th") == F.col("th_"))
    table = lambda df: df.select(F.col("doc_id").alias("doc_id_"), F.col("th").alias("th_")).distinct()
    held = documents.select(F.struct(*documents.columns).alias("__row"), *key)
    kept = held.join(table(rows.where(~F.col("first"))), same, "left_anti")
    # rows that a class repeats as a whole
    twice = staged(table(rows.where("first").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("k")).where("k > 1")), "repeated_rows")
    if not twice.isEmpty():
        one = kept.join(twice, same, "left_semi").groupBy("__id", "__th").agg(F.first("__row").alias("__row"))
        kept = kept.join(twice, same, "left_anti").unionByName(one)
    return kept.select("__row.*")
