"""Hard negatives against all pairs in plain integers."""

import math
import random

import numpy as np
import pytest

from changeloom.llm import anchor_tree

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score double, block int"


def rows_of(n, seed, wide=6):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(wide)] for _ in range(9)]
    rows = []
    for k in range(n):
        centre, spread = rng.choice(centres), rng.choice([0.0, 0.02, 0.3])
        rows.append((3 * k - 30, [x + rng.gauss(0, spread) for x in centre], rng.randrange(4)))
    return rows


def brute_force(rows, every, most, few, share):
    number = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    taken = {}
    for k, v, label in sorted((r for r in rows if None not in r and None not in r[1] and all(map(math.isfinite, r[1]))), key=lambda r: (r[0], r[2], r[1])):
        taken.setdefault(k, (label, number(v)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (label, v) in taken.items():
        if a % every:
            continue
        others = sorted((-dot(v, w), b, other == label) for b, (other, w) in taken.items() if b != a)
        for score, p, _ in [x for x in others if x[2]][:most]:
            fits = [(s, b) for s, b, same in others if not same and share[0] * -score <= 100 * -s <= share[1] * -score]
            out |= {(a, p, rank, b, -score, -s) for rank, (s, b) in enumerate(fits[:few], 1)}
    return out


@pytest.mark.parametrize("block", [7, 1_024])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(anchor_tree, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(anchor_tree, "TILE", 40)
    rows = rows_of(400, 1)
    rows += [(None, [1.0], 1), (900, None, 1), (902, [1.0, None], 1), (904, [float("nan")] * 6, 1), (906, [float("inf")] * 6, 2)]
    rows += [(908, [1.0] * 6, None), (910, [], 0), (912, [0.5, 0.5], 0), rows[5], (rows[6][0], [0.0] * 6, 3), (-910, [1.0] * 6, 9)]
    frame = spark.createDataFrame([(*r, "x", 0.5, 3) for r in rows], SCHEMA).repartition(3)
    found = anchor_tree.mine(frame, anchor_every=10)
    expected = brute_force(rows, 10, 5, 3, (50, 95))
    assert expected and {tuple(r) for r in found.collect()} == expected
    assert found.count() == len(expected)


def test_large_components_are_exact(spark):
    rows = [(k, [1e6 * (k % 7 + 1), 3e6 - 100.25 * k], k % 2) for k in range(40)]
    frame = spark.createDataFrame([(*r, "x", 0.5, 3) for r in rows], SCHEMA)
    found = {tuple(r) for r in anchor_tree.mine(frame, anchor_every=5).collect()}
    assert found == brute_force(rows, 5, 5, 3, (50, 95)) and found
    vast = spark.createDataFrame([(k, [3e38], k % 2, "x", 0.5, 3) for k in range(20)], SCHEMA)
    assert anchor_tree.mine(vast, anchor_every=5).count() == 0


def test_empty_and_single_label(spark):
    frame = spark.createDataFrame([(k, [1.0, 0.5], 1, "x", 0.5, 3) for k in range(60)], SCHEMA)
    assert anchor_tree.mine(frame).count() == 0
    assert anchor_tree.mine(frame.limit(0)).count() == 0


def test_bounds_spare_scores_where_anchors_are_close():
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (40, 32)).astype(float)
    near = lambda n: centres[rng.integers(0, 40, n)] + rng.integers(-2, 3, (n, 32))
    walk = anchor_tree.Walk({"id": np.arange(300), "label": np.zeros(300, int), "vector": near(300)})
    tile = {"id": np.arange(1_000), "label": np.ones(1_000, int), "vector": near(1_000)}
    low, high = np.full(300, 300_000.0), np.full(300, 400_000.0)
    a, b, score = walk.near(tile, False, low, high)
    every = walk.points @ tile["vector"].T
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(x.tolist() for x in np.nonzero((every >= 300_000) & (every <= 400_000)))))
    assert (every[a, b] == score).all() and walk.scored < 0.5 * walk.pairs


def test_tree_joins_all_points_by_shortest_edges():
    points = np.array([[0.0], [1.0], [3.0], [7.0], [7.0]])
    order, parent, edge = anchor_tree.spanning_tree(points)
    assert sorted(order.tolist()) == [0, 1, 2, 3, 4] and (parent < np.arange(5)).all()
    assert sorted(edge.tolist()) == [0, 0, 1, 2, 4]
