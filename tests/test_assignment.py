"""The largest total gain against all permutations, and against a chain's known optimum, by tasks and by bids."""

import itertools
import random

import numpy as np
import pytest

from metrika.operators import assignment as H
from metrika.operators import graphs as G
from metrika.plans import objects as O

PAIRS = "k int, a int, b int, iou double"


def best_total(gain: dict, n: int, m: int) -> float:
    if n > m:
        return best_total({(b, a): g for (a, b), g in gain.items()}, m, n)
    return max((sum(gain.get((a, b), 0) for a, b in enumerate(order)) for order in itertools.permutations(range(m), n)), default=0)


def test_best_pairs_against_all_permutations():
    r = random.Random(1)
    for _ in range(400):
        n, m = r.randint(1, 6), r.randint(1, 6)
        gain = {(a, b): r.choice([1, 5, 5, r.randint(1, 40)]) for a in range(n) for b in range(m) if r.random() < 0.7}
        if not gain:
            continue
        edges = list(gain)
        r.shuffle(edges)
        took = H.best_pairs(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), [gain[e] for e in edges])
        used = [edges[k] for k in took]
        assert len({a for a, _ in used}) == len({b for _, b in used}) == len(used)
        assert sum(gain[e] for e in used) == best_total(gain, n, m)


@pytest.mark.parametrize("part_edges", [H.PART_EDGES, 1])
def test_assignment_is_optimal_in_every_key(spark, monkeypatch, part_edges):
    monkeypatch.setattr(H, "BID_UNIT", 256)
    r = random.Random(6)
    rows = [(k, a, b, r.randrange(1, 257) / 256) for k in range(4 if part_edges > 1 else 1) for a in range(4) for b in range(4) if r.random() < 0.6]
    rows += [(9, a, b, 0.5) for a in range(3) for b in range(2)] + [(10, 1, 1, 0.25), (11, 1, 1, 0.0), (None, 1, 1, 0.5)]  # equal gains, a pair alone, no gain
    got = {}
    for x in H.assign(spark.createDataFrame(rows, PAIRS), "k", 0.0, part_edges).collect():
        got.setdefault(x["k"], []).append((x["a"], x["b"], x["iou"]))
    assert 11 not in got and got[10] == [(1, 1, 0.25)] and got[None] == [(1, 1, 0.5)] and len(got[9]) == 2
    for k in sorted(x for x in got if x in (0, 1, 2, 3, 9)):
        gain = {(a, b): x for i, a, b, x in rows if i == k}
        assert sum(x for *_, x in got[k]) == pytest.approx(best_total(gain, 4, 4), abs=1e-5)
        assert len({a for a, *_ in got[k]}) == len({b for _, b, _ in got[k]}) == len(got[k])


def chain(n, seed):
    """Pairs a0 b0, b0 a1, a1 b1, ... of which each shares an end with the next, and the largest total of pairs without common ends."""
    r = random.Random(seed)
    w = [r.randrange(20, 257) / 256 for _ in range(n)]
    with_last, without = 0.0, 0.0
    for x in w:
        with_last, without = without + x, max(with_last, without)
    return [(0, (k + 1) // 2, k // 2, x) for k, x in enumerate(w)], max(with_last, without)


@pytest.mark.parametrize("n, part_edges", [(9_999, H.PART_EDGES), (10, 3)])
def test_one_key_that_hangs_together(spark, monkeypatch, n, part_edges):
    monkeypatch.setattr(H, "BID_UNIT", 256)
    rows, best = chain(n, 3)
    got = H.assign(spark.createDataFrame(rows, PAIRS), "k", 0.0, part_edges).collect()
    assert sum(x["iou"] for x in got) == pytest.approx(best, abs=n * 2.0**-20)
    assert len({x["a"] for x in got}) == len({x["b"] for x in got}) == len(got)


def test_a_dense_key_is_solved_over_its_core(spark, monkeypatch):
    monkeypatch.setattr(H, "bids", lambda edges: pytest.fail("bids over a dense key"))
    r, n = random.Random(4), 60
    gain = {(a, b): r.randrange(1, 257) / 256 for a in range(n) for b in range(n)}
    rows = [(k, a, b, x) for (a, b), x in gain.items() for k in (0, None)] + [(1, a, b, 0.5) for a in range(n) for b in range(n)]  # copies are worth the same
    got = H.assign(spark.createDataFrame(rows, PAIRS), "k", 0.0, part_edges=1500).collect()
    took = H.best_pairs(np.array([a for a, _ in gain]), np.array([b for _, b in gain]), [int(x * 256) for x in gain.values()])
    best = sum(list(gain.values())[k] for k in took)
    for k, total in ((0, best), (None, best), (1, n / 2)):
        own = [x for x in got if x["k"] == k]
        assert sum(x["iou"] for x in own) == pytest.approx(total, abs=1e-9)
        assert len({x["a"] for x in own}) == len({x["b"] for x in own}) == len(own)


def iou_of(p, q):
    w, h = max(0.0, min(p[2], q[2]) - max(p[0], q[0])), max(0.0, min(p[3], q[3]) - max(p[1], q[1]))
    total = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h
    return w * h / total if total else 0.0


def test_boxes_are_assigned_without_a_table_of_pairs(spark, monkeypatch):
    r, n, sizes, was = random.Random(8), 150, [], H.written
    monkeypatch.setattr(H, "BLOCK", 100, raising=False)
    grid = lambda: [(x, y, x + r.randint(20, 40), y + r.randint(20, 40)) for x, y in ((r.randint(0, 12), r.randint(0, 12)) for _ in range(n))]
    a, b = grid(), grid()
    a, b = a + a[: n // 3], b + b[: n // 3]  # copies gain the same
    rows = lambda boxes: [(k, 7, *map(float, x)) for k, x in enumerate(boxes)] + [(900, 7, None, 0.0, 1.0, 1.0), (901, None, 0.0, 0.0, 9.0, 9.0), (902, 7, 0.0, 0.0, float("nan"), 9.0), (903, 8, 5.0, 5.0, 5.0, 5.0)]
    left, right = (spark.createDataFrame(rows(x), "vec_id long, label int, x1 double, y1 double, x2 double, y2 double") for x in (a, b))

    def spy(df, name):
        out = was(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(H, "written", spy)
    got = O.assigned(left, right).collect()
    gain = {(i, j): iou_of(p, q) for i, p in enumerate(a) for j, q in enumerate(b) if iou_of(p, q) > 0}
    took = H.best_pairs(np.array([i for i, _ in gain]), np.array([j for _, j in gain]), [int(x * H.UNIT) for x in gain.values()])
    best = [x for k, x in enumerate(gain.values()) if k in set(took)]
    assert len({x["a"] for x in got}) == len({x["b"] for x in got}) == len(got)
    assert all(x["iou"] == gain[x["a"], x["b"]] and x["iou"] >= 0.3 and x["label"] == 7 for x in got)
    assert min(best) >= 0.3 and sum(x["iou"] for x in got) == pytest.approx(sum(best), abs=1e-4)
    assert len(gain) > 5 * max(sizes)


def test_worths_bound_all_gains():
    r = random.Random(3)
    for _ in range(100):
        edges = {(r.randrange(6), r.randrange(6)): r.randint(1, 40) for _ in range(14)}
        rows, cols = ([sorted({e[k] for e in edges}).index(e[k]) for e in edges] for k in (0, 1))
        took, row, col = H.solved(np.array(rows), np.array(cols), list(edges.values()))
        assert min(row + col) >= 0 and all(g <= row[a] + col[b] for a, b, g in zip(rows, cols, edges.values(), strict=True))
        assert sum(row) + sum(col) == sum(list(edges.values())[k] for k in took)


def test_threshold_in_single_precision(spark):
    pairs = spark.createDataFrame([("k", 1, 1, 0.7), ("k", 1, 2, 0.6), ("k", 2, 2, 0.69), ("j", 5, 5, 0.9), ("j", 6, 5, 0.95)], "k string, a int, b int, iou double")
    assert {(r.a, r.b) for r in H.assign(pairs, "k", 0.7).collect()} == {(1, 1), (6, 5)}
    assert H.assign(pairs.limit(0), "k", 0.7).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    r = random.Random(2)
    order = list(range(300))
    r.shuffle(order)
    edges = list(itertools.pairwise(order)) + [(1000, k) for k in range(1001, 1100)] + [(2000, 2000)]
    got = {x["node"]: x["component"] for x in G.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[k] for k in range(300)} == {0} and {got[k] for k in range(1000, 1100)} == {1000} and 2000 not in got
    assert G.components(spark.createDataFrame([], "a int, b int")).count() == 0
