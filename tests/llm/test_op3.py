import itertools
import random

import numpy as np
import pytest
import xxhash

from trawl.llm import op3_simhash as sim


def slow_fingerprint(text, shingle=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in root}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_in_the_radius(radius):
    masks = sim.covering_masks(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for flips in itertools.combinations(range(0, 64, 2 if radius == 3 else 1), radius):
        diff = sum(1 << p for p in flips)
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("limit", [2048, 3])
def test_components_equal_brute_force(spark, limit):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randrange(25)):  # chains of links, and clusters about one value
            x ^= sum(1 << p for p in rng.sample(range(64), rng.randrange(1, 4)))
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = sim.connected(sim.bucket_edges(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), limit=limit))
    mate = {r.a: r.b for r in got.collect()}
    want = classes(fps)
    groups = lambda of: {frozenset(x for x in fps if of(x) == r) for r in map(of, fps)}
    assert groups(lambda f: mate.get(signed(f), signed(f))) == groups(want.get)


def test_operator_equals_brute_force(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    of = classes(set(fps))
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r.doc_id is not None:
            least[of[f]] = min(least.get(of[f], r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f, least.get(of[f])) for r, f in zip(rows, fps, strict=True)), key=repr)
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in sim.near_duplicates(odd_docs).collect()]
    assert sorted(got, key=repr) == want
    assert sim.near_duplicates(no_docs).collect() == []


def test_keep_one(spark, odd_docs):
    kept = sim.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    found = sim.near_duplicates(odd_docs)
    assert kept.count() == found.select("root").distinct().count()
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 7, None}
    assert not {r.doc_id for r in kept.collect()} & {2, 3, 5}  # 6 differs by letters outside A-Z


def test_large_bucket_is_not_paired():
    x = np.arange(4096, dtype=np.int64)
    edges = sim.spanning_edges(x)
    assert len(edges) == 4095 and {b for _, b in edges} == {0}
