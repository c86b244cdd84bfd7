"""Importance resampling and centroid clustering by brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.edge import no_documents, odd_documents
from vitrine.llm import clustering, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_buckets(text, buckets, max_n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute_ranks(docs, target, share, min_words, seed, buckets, max_n):
    """{row: (features, weight, score, rank)}."""
    source, wanted = (Counter(b for t in texts for b in brute_buckets(t, buckets, max_n)[1]) for texts in ([t for _, t in docs], target))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + float(buckets)) / ((source[b] + 1.0) * (t_all + float(buckets))))) for b in source}
    out, fit = {}, []
    for row, (doc_id, text) in enumerate(docs):
        words, found = brute_buckets(text, buckets, max_n)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out[row] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(words) >= min_words:
            fit.append((-out[row][2], math.inf if doc_id is None else doc_id, row))
    for place, (_, _, row) in enumerate(sorted(fit)[: share * len(fit) // 100], 1):
        out[row][3] = place
    return out


def texts(rnd, n, words):
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60))) + rnd.choice(["", "\n", " Ünï-Cödé ", "9a"]) for _ in range(n)]


@pytest.mark.parametrize("buckets, max_n, share, min_words", [(10_000, 2, 25, 20), (97, 3, 50, 1), (1, 1, 100, 0)])
def test_ranks_by_brute_force(spark, buckets, max_n, share, min_words):
    rnd = random.Random(4)
    docs = list(enumerate(texts(rnd, 300, ["Alpha", "beta", "gamma", "delta", "été", "x1", "漢字"])))
    target = texts(rnd, 20, ["beta", "gamma", "omega", "beta"]) + [None]
    found = importance.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(t,) for t in target], "text string"), share, min_words, 7, buckets, max_n)
    want = brute_ranks(docs, target, share, min_words, 7, buckets, max_n)
    assert {r.doc_id: [r.imp_features, r.imp_weight, r.imp_score, r.imp_rank] for r in found.collect()} == want


def test_long_texts_are_read_in_pieces(monkeypatch):
    rnd = random.Random(6)
    docs = [" ".join(rnd.choice("ab cd ef gh ij".split()) for _ in range(n)) for n in (900, 0, 1, 2, 400, 3)] + ["w" * 500, ""]
    want = Counter((i, b) for i, t in enumerate(docs) for b in brute_buckets(t, 50, 3)[1])
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(importance, "SLICE", size)
        got = Counter((int(o), int(b)) for _, owner, bucket in importance.features([t.encode() for t in docs], 50, 3) for o, b in zip(owner, bucket))
        assert got == want


def test_documents_like_the_target_are_drawn(spark):
    rnd = random.Random(8)
    like, unlike = ("sun sea sand wind wave".split(), "tax form desk file memo".split())
    docs = [(i, " ".join(rnd.choice(like if i % 4 == 0 else unlike) for _ in range(60)), "x") for i in range(800)]
    target = spark.createDataFrame([(" ".join(rnd.choice(like) for _ in range(300)),)], "text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string, rank string")
    drawn = importance.resampled(frame, target, share=20)
    rows = drawn.collect()
    assert len(rows) == 160 and sum(r.doc_id % 4 == 0 for r in rows) >= 110 and drawn.columns == ["doc_id", "text", "rank", "imp_weight", "imp_score"]
    ranked = {r.doc_id for r in importance.ranked(frame, target, share=20).where("imp_rank is not null").collect()}
    assert ranked == {r.doc_id for r in rows}


def test_repeated_rows_of_one_id_are_ranked(spark):
    """A third of all rows are one text under one id, others have no id; ranks stay 1, 2, 3..."""
    rnd = random.Random(9)
    docs = [(5, "one text " * 15)] * 200 + [(None, "no id " * 15)] * 150 + [(i, " ".join(rnd.choice("one two text id no".split()) for _ in range(30))) for i in range(250)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    rows = importance.ranked(frame, spark.createDataFrame([("two one",)], "text string"), share=80).collect()
    want = brute_ranks(docs, ["two one"], 80, 20, 7, 10_000, 2)
    assert Counter((r.doc_id, r.imp_score) for r in rows) == Counter((docs[i][0], v[2]) for i, v in want.items())
    assert sorted(r.imp_rank for r in rows if r.imp_rank) == list(range(1, 481))
    assert {r.imp_rank: (r.doc_id, r.imp_score) for r in rows if r.imp_rank} == {v[3]: (docs[i][0], v[2]) for i, v in want.items() if v[3]}


def test_resampling_odd_documents(spark):
    docs = odd_documents(spark)
    target = spark.createDataFrame([("same line",)], "text string")
    rows = importance.ranked(docs, target, min_words=1).collect()
    assert len(rows) == docs.count() and {r.imp_features for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert set(importance.resampled(docs, target, min_words=1, share=100).columns) == {*docs.columns, "imp_weight", "imp_score"}
    assert importance.ranked(no_documents(spark), target).collect() == [] and importance.resampled(no_documents(spark), target).count() == 0
    assert importance.ranked(docs, target.where("false")).count() == docs.count()


# ---- clustering -----------------------------------------------------------------------------------


def brute_nearest(points, centroids):
    return ((points[:, None, :] - centroids[None, :, :]) ** 2).sum(2).argmin(1)


def walked(points, tree, centroids):
    over = clustering.cover_tree(centroids, 1)
    found = np.full(len(points), -1)
    whole = 0
    for a, b, nearest in clustering.nearest(points[tree.order], tree, centroids[over.order], over):
        assert (found[a:b] == -1).all()
        found[a:b] = nearest
        whole += (b - a) * isinstance(nearest, int)
    out = np.empty(len(points), dtype=np.int64)
    out[tree.order] = found
    return out, whole


def test_dual_trees_by_brute_force():
    rng = np.random.default_rng(1)
    for t in range(150):
        n, k, dims = int(rng.integers(1, 300)), int(rng.integers(1, 40)), int(rng.integers(1, 6))
        wide = (3, 30, 1 << 27)[t % 3]
        points = rng.integers(-wide, wide, (n, dims))
        if t % 4 == 0:
            points[: n // 2] = points[0]
        centroids = rng.integers(-wide, wide, (k, dims)) if t % 2 else points[rng.integers(0, n, k)]
        found, _ = walked(points, clustering.cover_tree(points, int(rng.integers(1, 20))), centroids)
        assert (found == brute_nearest(points, centroids)).all()


def test_cover_trees_cover_and_separate():
    rng = np.random.default_rng(2)
    for n, dims in ((1, 2), (200, 2), (500, 8)):
        points = rng.integers(-100, 100, (n, dims))
        tree = clustering.cover_tree(points, 4)
        placed = points[tree.order]
        assert sorted(tree.order) == list(range(n)) and (tree.start[0], tree.end[0]) == (0, n)
        for i in range(len(tree.start)):
            inside = placed[tree.start[i] : tree.end[i]]
            assert np.sqrt(((inside - placed[tree.centre[i]]) ** 2).sum(1)).max() <= tree.radius[i] * (1 + 1e-9) and tree.start[i] <= tree.centre[i] < tree.end[i]
            kids = range(tree.child[i], tree.child[i] + tree.children[i])
            if len(kids):
                assert tree.start[kids[0]] == tree.start[i] and tree.end[kids[-1]] == tree.end[i] and all(tree.end[a] == tree.start[a + 1] for a in kids[:-1])
                centres = placed[tree.centre[list(kids)]]
                apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[~np.eye(len(kids), dtype=bool)]
                assert apart.min() > 0 and tree.centre[i] in tree.centre[list(kids)]


def test_tight_groups_are_assigned_whole():
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (40, 8))
    points = centres[rng.integers(0, 40, 2000)] + rng.integers(-9, 9, (2000, 8))
    found, whole = walked(points, clustering.cover_tree(points), centres)
    assert (found == brute_nearest(points, centres)).all() and whole > 1900


def brute_clusters(rows, k, rounds, seed, scale, dims):
    """[(id, cluster, distance)], inertia by cluster, centroids."""
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = np.array([v for _, v in order[:k]], dtype=np.int64)
    points = np.array([v for _, v in kept], dtype=np.int64)
    for _ in range(rounds):
        found = brute_nearest(points, centroids)
        centroids = np.array([[s // (found == c).sum() for s in points[found == c].sum(0).tolist()] if (found == c).any() else centroids[c] for c in range(len(centroids))])
    found = brute_nearest(points, centroids)
    distance = ((points - centroids[found]) ** 2).sum(1)
    return sorted(((i is None, i or 0, c, d) for (i, _), c, d in zip(kept, found.tolist(), distance.tolist()))), [int(distance[found == c].sum()) for c in range(len(centroids))], centroids


@pytest.mark.parametrize("block, leaf, k", [(2048, 16, 6), (7, 2, 12), (1, 1, 3), (64, 5, 500)])
def test_clusters_by_brute_force(spark, block, leaf, k):
    rnd = random.Random(10)
    rows = [(i, [rnd.gauss(i % 5, 0.4) for _ in range(4)]) for i in range(300)] + [(7, [0.5] * 4)] * 90 + [(None, [0.25, -0.001, 1.0, 2.0])] * 3
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0]), (904, [1.0, math.nan, 1.0, 1.0]), (905, [1.0, math.inf, 1.0, 1.0]), (906, [-math.inf] * 4)]
    frame = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    found = clustering.clustered(frame, k, 3, 2, 16, 4, block=block, leaf=leaf).collect()
    want, inertia, centroids = brute_clusters(rows, k, 3, 2, 16, 4)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found) == want
    for r in found:
        assert r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()


def test_no_vectors_and_components_out_of_reach(spark):
    empty = clustering.clustered(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="too large"):
        clustering.clustered(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()
