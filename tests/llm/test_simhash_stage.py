"""The near-copy stage works by fingerprints in BK-trees: radius, trees, and what they leave out."""

import numpy as np
import pytest

from talus.llm import neardup


def distance(a, b):
    return int(np.bitwise_count(a ^ b).sum())


@pytest.mark.parametrize("common, extra", [((4, 0), 1), ((8, 1), 1), ((12, 1), 1), ((40, 5), 5), ((40, 0), 10), ((800, 100), 100)])
def test_radius(common, extra):
    """Sets of similarity 0.8 lie within the radius, unrelated ones far out."""
    r, (shared, own) = np.random.default_rng(common[0] + extra), common
    assert shared >= 0.8 * (shared + own + extra)
    for _ in range(200):
        x = r.integers(0, 1 << 63, shared + own + extra, dtype=np.uint64)
        a, b = np.sort(x[: shared + own]), np.sort(np.concatenate((x[:shared], x[shared + own :])))
        c = r.integers(0, 1 << 63, len(b), dtype=np.uint64)
        fa, fb, fc = neardup.wide_fingerprints([a, b, c])
        assert distance(fa, fb) <= neardup.radius(len(b)) < distance(fa, fc)


def test_trees_list_neighbours_only(spark):
    """In one shard: pairs within the radius, of like size and different components, sets of one fingerprint among them."""
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, neardup.WIDE, dtype=np.uint64)

    def moved(bits):
        out = base.copy()
        for k in r.choice(neardup.WIDE * 64, bits, replace=False):
            out[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
        return out.tobytes()

    tags = np.arange(neardup.BANDS, dtype=np.uint32).tobytes()
    sketch = bytes(neardup.SKETCH // 2)
    # key, node, n, component, wide, sketch, tags, weight
    rows = [(64 * 9, node, n, component, wide, sketch, tags, 1) for node, n, component, wide in [(1, 100, 1, moved(0)), (2, 100, 2, moved(0)), (3, 100, 3, moved(neardup.NEAR)), (4, 100, 4, moved(neardup.NEAR + 250)), (5, 79, 5, moved(0)), (6, 100, 1, moved(0))]]
    rows.append((64 * 9, 7, 100, 7, moved(0), bytes([255]) * len(sketch), tags, 1))  # a neighbour, but for its sketch
    shared = spark.createDataFrame(rows, "key long, node long, n long, component long, wide binary, sketch binary, tags binary, weight long")
    found = {(x.u, x.v) for x in neardup._all_left(shared, 0.8).collect()}
    assert found == {(1, 2), (1, 3), (2, 3), (2, 6), (3, 6)}
    assert not neardup._all_left(shared.withColumn("key", shared.key + 1), 0.8).count()  # another shard lists them
    star = neardup._with_star(shared.selectExpr("*", "CASE WHEN node = 4 THEN -1L ELSE 0L END AS fp"), 0.8, 1)
    assert all(4 not in x for x in star.collect()) and star.count()
