"""Centroid clustering by dual-tree Lloyd rounds over integer vectors.

Vectors are cut into blocks of at most ``block`` rows where they lie, and each block gets a cover
tree: its centres are taken farthest first, so the centres of the net of every level are apart by more than
the level's radius and cover all vectors within it. The trees are written once and read in
each round. A round builds a tree of the same kind over the centroids and walks both together: a
pair of nodes goes if no vector of the one can have its nearest centroid in the other, by the
distance of their centres and their radii. A vector node that is left with one centroid is assigned
whole, its sum taken from running sums of the block; at the leaves vectors and the centroids left are
compared exactly, in integers, ties to the smaller number. Each task adds up one row for each centroid; Spark adds the tasks' rows.

Distances, sums, means and ties are exact, so the result depends neither on blocks nor on the trees,
which save comparisons only. In many dimensions far apart vectors leave little to prune; then a round does
the comparisons of a plain one, and the bounds on top.

Bounds: a task holds one block with its tree, and k rows of sums; the driver gets k rows a round. No
group of vectors meets in one task, whatever its size: equal vectors fall into one leaf of radius 0 of their block.

Cases: vectors that are null, of another length, or hold a null or non-finite component are left out;
ids may be null or repeated (every row counts; a null id hashes as the empty string), start centroids
equal in hash are ordered by their components; with fewer than k vectors there are that many centroids; of equal centroids the one
with the smallest number gets all vectors; no vectors give an empty result; extra columns are not read. Components whose integer
is beyond 2^27 raise an error, as their squared distances need not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import staged
from vitrine.session import shared_dir

#: Vectors of a block, and about how many of them a leaf holds.
BLOCK, LEAF = 2048, 16
#: Bytes of a row group of blocks, which bounds what a reader holds at a time.
ROW_GROUP = 16 << 20
#: Ratio of the radii of two levels, as cover trees mostly take it.
BASE = 1.3
#: Largest magnitude of a component, and the largest whose dot products floating point numbers hold exactly.
LARGEST, FLOAT_EXACT = 1 << 27, 1 << 22


def kept_vectors(rows: DataFrame, scale: int = 256, dims: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): the vectors with ``dims`` finite components, each component x as floor(scale * x)."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda x: F.when(F.abs(x.cast("double")) * scale <= LARGEST, F.floor(x.cast("double") * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))
    return rows.where((F.size(e) == dims) & finite).select(F.col(vec_id).alias("id"), F.transform(e, whole).alias("v"))


# ---- cover trees ----------------------------------------------------------------------------------


class Tree:
    """A cover tree over integer points, which it keeps in the order of its leaves.

    Node i holds the points ``start[i]`` to ``end[i]``, all within ``radius[i]`` of its centre, which is point ``centre[i]``; its
    children are the nodes ``child[i]`` to ``child[i] + children[i]``.
    """

    def __init__(self, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray) -> None:
        self.order, self.nodes, self.radius = order, nodes, radius
        self.start, self.end, self.centre, self.child, self.children = nodes


def _farthest_first(points: np.ndarray, most: int) -> tuple[list[int], list[float], np.ndarray]:
    """Centres with the distance of each to those before it, and every point's nearest centre."""
    chosen, gaps = [0], [np.inf]
    near = np.zeros(len(points), dtype=np.int64)
    gap = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(chosen) < most and (far := int(gap.argmax())) >= 0 and gap[far] > 0:
        d = np.sqrt(((points - points[far]) ** 2).sum(1))
        closer = d < gap
        near[closer] = len(chosen)
        chosen.append(far)
        gaps.append(float(gap[far]))
        gap = np.minimum(gap, d)
    return chosen, gaps, near


def cover_tree(vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree with leaves of about ``leaf`` points; equal points are never parted."""
    points = vectors.astype(np.float64)
    chosen, gaps, near = _farthest_first(points, max(1, -(-len(points) // leaf)))
    centres = points[chosen]
    parent, centre, held = [-1], [0], np.zeros(len(chosen), dtype=np.int64)  # held: the lowest node of each centre so far
    inside, level = 1, gaps[1] if len(chosen) > 1 else 0.0
    while inside < len(chosen):
        level = min(level / BASE, gaps[inside] * (1 - 1e-12))  # a level without new centres is left out
        upto = inside
        while upto < len(chosen) and gaps[upto] > level:
            upto += 1
        d = ((centres[inside:upto, None, :] - centres[None, :inside, :]) ** 2).sum(2) if inside < 64 else (centres[inside:upto] ** 2).sum(1)[:, None] + (centres[:inside] ** 2).sum(1)[None, :] - 2 * centres[inside:upto] @ centres[:inside].T
        above = d.argmin(1)
        for p in np.unique(above).tolist():
            parent.append(int(held[p]))
            centre.append(p)
        new_self = {p: len(parent) - len(np.unique(above)) + i for i, p in enumerate(np.unique(above).tolist())}
        for i, p in enumerate(above.tolist()):
            parent.append(int(held[p]))
            centre.append(inside + i)
            held[inside + i] = len(parent) - 1
        for p, node in new_self.items():
            held[p] = node
        inside = upto
    # nodes by depth, children of a node side by side
    kids: dict[int, list[int]] = {}
    for node, above_it in enumerate(parent[1:], 1):
        kids.setdefault(above_it, []).append(node)
    listed, child = [0], []
    for node in listed:
        child.append(len(listed))
        listed.extend(kids.get(node, []))
    children = np.array([len(kids.get(n, [])) for n in listed])
    child = np.array(child)
    number = np.empty(len(listed), dtype=np.int64)
    number[listed] = np.arange(len(listed))
    # points by leaf, leaves in depth-first order
    size = np.zeros(len(listed), dtype=np.int64)
    leaf_of = number[held[near]]
    np.add.at(size, leaf_of, 1)
    for i in range(len(listed) - 1, -1, -1):
        if children[i]:
            size[i] = size[child[i] : child[i] + children[i]].sum()
    start = np.zeros(len(listed), dtype=np.int64)
    for i in range(len(listed)):
        if children[i]:
            own = slice(child[i], child[i] + children[i])
            start[own] = start[i] + np.cumsum(size[own]) - size[own]
    order = np.argsort(start[leaf_of], kind="stable")
    centre_of = np.array(chosen)[np.array(centre)[listed]]
    place = np.empty(len(points), dtype=np.int64)
    place[order] = np.arange(len(points))
    ordered = points[order]
    radius = np.array([np.sqrt(((ordered[s : s + n] - points[c]) ** 2).sum(1).max()) for s, n, c in zip(start, size, centre_of)])
    return Tree(order, np.array([start, start + size, place[centre_of], child, children]), radius)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` from all of ``b``; exact for whole numbers."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def nearest(vectors: np.ndarray, tree: Tree, centroids: np.ndarray, over: Tree) -> Iterator[tuple[int, int, np.ndarray | int]]:
    """(start, end, nearest centroid) of runs of a block's vectors: one number for a node that is assigned whole, else one for each.

    ``vectors`` are in the tree's order; so are the centroids in the order of ``over``, whose ``order`` has their numbers.
    """
    exact = np.float64 if max(np.abs(vectors).max(), np.abs(centroids).max()) <= FLOAT_EXACT else np.int64
    own, others = vectors.astype(exact), centroids.astype(exact)
    points, means = vectors.astype(np.float64), centroids.astype(np.float64)
    v, c = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)  # the pairs, those of a vector node side by side
    slack = 1e-9
    while len(v):
        d = np.sqrt(((points[tree.centre[v]] - means[over.centre[c]]) ** 2).sum(1))
        first = np.flatnonzero(np.diff(v, prepend=-1))
        group = np.cumsum(np.diff(v, prepend=-1) != 0) - 1
        upper = np.minimum.reduceat(d + tree.radius[v], first)
        left = (d - tree.radius[v] - over.radius[c]) * (1 - slack) <= upper[group] * (1 + slack) + slack
        v, c = v[left], c[left]
        first = np.flatnonzero(np.diff(v, prepend=-1))
        n = np.diff(first, append=len(v))
        group = np.repeat(np.arange(len(first)), n)
        ready = over.children[c] == 0
        wide = np.maximum.reduceat(np.where(ready, -1.0, over.radius[c]), first)  # -1: only single centroids are left
        node = v[first]
        single = (n == 1) & ready[first] & (over.end[c[first]] - over.start[c[first]] == 1)
        for i in np.flatnonzero(single):
            yield tree.start[node[i]], tree.end[node[i]], int(over.order[over.start[c[first[i]]]])
        bottom = ~single & (tree.children[node] == 0) & (wide < 0)
        for i in np.flatnonzero(bottom):
            a, b = tree.start[node[i]], tree.end[node[i]]
            places = np.concatenate([np.arange(over.start[x], over.end[x]) for x in c[first[i] : first[i] + n[i]]])
            places = places[np.argsort(over.order[places])]
            yield a, b, over.order[places][_apart(own[a:b], others[places]).argmin(1)]
        # the wider side is opened: centroid nodes while they are as wide as the vector node, or that is a leaf
        open_c = ~single & ~bottom & (wide >= 0) & ((wide >= tree.radius[node]) | (tree.children[node] == 0))
        open_v = ~single & ~bottom & ~open_c
        by_c = open_c[group]
        opened = by_c & ~ready & ((over.radius[c] >= tree.radius[v]) | (tree.children[v] == 0) | (over.radius[c] == wide[group]))
        stay = by_c & ~opened
        times = over.children[c[opened]]
        more_c = np.repeat(over.child[c[opened]], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        next_v, next_c = [v[stay], np.repeat(v[opened], times)], [c[stay], more_c]
        times = tree.children[v[open_v[group]]]
        next_v.append(np.repeat(tree.child[v[open_v[group]]], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)))
        next_c.append(np.repeat(c[open_v[group]], times))
        v, c = np.concatenate(next_v), np.concatenate(next_c)
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]


# ---- Lloyd rounds ---------------------------------------------------------------------------------

_BLOCKS = T.StructType([
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("vectors", T.BinaryType()), T.StructField("nodes", T.BinaryType()), T.StructField("radius", T.BinaryType()),
])


def blocks(vectors: DataFrame, dims: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """The rows (id, v) as blocks of at most ``block`` of them with their trees."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        rows: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, rows, held
            points = np.concatenate(rows)
            tree = cover_tree(points, leaf)
            narrow = points[tree.order].astype(np.int32)
            one = [[[ids[i] for i in tree.order]], [narrow.tobytes()], [tree.nodes.astype(np.int32).tobytes()], [tree.radius.tobytes()]]
            ids, rows, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, type=kind) for x, kind in zip(one, (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()))], names=_BLOCKS.names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - held)
                ids += part.column(0).to_pylist()
                rows.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                held, at = held + part.num_rows, at + part.num_rows
                if held == block:
                    yield close()
        if held:
            yield close()

    return vectors.select("id", "v").mapInArrow(built, _BLOCKS)


def _read(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, vectors, nodes, radius = (batch.column(j)[i] for j in range(4))
            points = np.frombuffer(vectors.as_py(), dtype=np.int32).reshape(-1, dims).astype(np.int64)
            yield ids.values, points, Tree(np.arange(len(points)), np.frombuffer(nodes.as_py(), dtype=np.int32).reshape(5, -1).astype(np.int64), np.frombuffer(radius.as_py()))


def _round(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = cover_tree(centroids, 1)
        ordered = centroids[over.order]
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, points, tree in _read(batches, dims):
            running = np.concatenate([np.zeros((1, dims), dtype=np.int64), np.cumsum(points, axis=0)])
            for a, b, found in nearest(points, tree, ordered, over):
                if isinstance(found, int):
                    counts[found] += b - a
                    sums[found] += running[b] - running[a]
                else:
                    counts += np.bincount(found, minlength=k)
                    np.add.at(sums, found, points[a:b])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(sums[some].tolist(), type=pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = trees.mapInArrow(summed, "cluster long, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    new = centroids.copy()
    for row in added.toLocalIterator():  # k rows at most
        new[row[0]] = [s // row[1] for s in row[2:]]
    return new


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims = centroids.shape[1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = cover_tree(centroids, 1)
        ordered = centroids[over.order]
        for ids, points, tree in _read(batches, dims):
            cluster = np.zeros(len(points), dtype=np.int64)
            for a, b, found in nearest(points, tree, ordered, over):
                cluster[a:b] = found
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(((points - centroids[cluster]) ** 2).sum(1))], names=["id", "cluster", "distance"])

    return trees.mapInArrow(rows, "id long, cluster long, distance long")


def start_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:id``, in ascending order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()], dtype=np.int64)


def clustered(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dims: int = 64, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(``vec_id``, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    vectors = kept_vectors(embeddings, scale, dims, vec_id, embedding)
    centroids = start_centroids(vectors, k, seed)
    spark = embeddings.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], f"`{vec_id}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    path = f"{shared_dir(spark)}/trees"
    blocks(vectors, dims, block, leaf).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    trees = spark.read.schema(_BLOCKS).parquet(path)
    for _ in range(rounds):
        centroids = _round(trees, centroids)
    found = staged(_assigned(trees, centroids), "assigned")
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    clusters = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), digest) for i, digest in enumerate(digests)], "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select(F.col("id").alias(vec_id), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
