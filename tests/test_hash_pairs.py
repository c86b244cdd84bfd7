"""Pairs of near hashes and members of equal ones against brute force."""

import random

import pytest

from vitrine.operators import selection


def halves(x):
    return x >> 32, x & 0xFFFFFFFF


def near_hashes(n=160):
    rnd = random.Random(9)
    found = [rnd.getrandbits(64) for _ in range(n // 4)]
    while len(found) < n:
        x = rnd.choice(found)
        for bit in rnd.sample(range(64), rnd.choice([0, 1, 3, 6, 7, 10, 16])):
            x ^= 1 << bit
        found.append(x)
    return found


def brute_pairs(hashes, most):
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    ids = sorted(first.values())
    return sorted((a, b, d) for a in ids for b in ids if a < b and (d := (hashes[a] ^ hashes[b]).bit_count()) <= most)


@pytest.mark.parametrize(("most", "block"), [(0, 512), (6, 512), (6, 5), (16, 512), (16, 7)])
def test_near_pairs_by_brute_force(spark, most, block):
    hashes = near_hashes()
    rows = spark.createDataFrame([(i, *halves(h)) for i, h in enumerate(hashes)], "id long, high long, low long")
    assert sorted(map(tuple, selection.near_pairs(rows, most, block).collect())) == brute_pairs(hashes, most)


def test_copies_keep_their_links(spark):
    hashes = near_hashes()
    rows = spark.createDataFrame([(i, *halves(h)) for i, h in enumerate(hashes)], "id long, high long, low long")
    members = {r.id: (r.representative, r.copies) for r in selection.hash_members(rows).collect()}
    assert members == {i: (hashes.index(h), hashes.count(h)) for i, h in enumerate(hashes)}
    linked = {(r.a, r.b) for r in selection.near_pairs(rows, 6).collect()}
    all_pairs = {(a, b) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if (hashes[a] ^ hashes[b]).bit_count() <= 6}
    first = lambda i: members[i][0]
    assert all_pairs == {(a, b) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if first(a) == first(b) or tuple(sorted((first(a), first(b)))) in linked}
