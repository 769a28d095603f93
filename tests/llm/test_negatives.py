"""Hard negatives against a plain version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import negatives as n

SCHEMA = "vec_id long, embedding array<float>, label int, id string, d int, windows int"


def plain(rows, positives=5, negatives=10, least=30, most=90):
    own = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        if all(abs(x) < n.LARGEST for x in ints):
            own.append((i, label, ints))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in dict.fromkeys((i, label, tuple(v)) for i, label, v in own):
        if i % 100:
            continue
        all_ = sorted((-score(v, x), j, lab) for j, lab, x in own)
        for s, p, _ in [a for a in all_ if a[2] == label and a[1] != i][:positives]:
            found = [a for a in all_ if a[2] != label and least * -s <= 100 * -a[0] <= most * -s][:negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(found)]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)
    out = n.mine(df, F.col("label"), F.col("id") % 100 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def some(count, dims=8, seed=1, copies=0):
    g = np.random.default_rng(seed)
    v = g.normal(size=(count, dims)).astype(np.float32)
    v[: count // 2] += 2
    if copies:
        v[g.permutation(count)[:copies]] = v[0]
    return [(int(i * 25), v[i].tolist(), int(g.integers(0, 3))) for i in range(count)]


@pytest.mark.parametrize("block", [3, 8192])
def test_plain_version(spark, block):
    rows = some(400)
    assert got(spark, rows, block=block) == plain(rows)


def test_ties_and_copies(spark):
    """A third of the rows has one vector: ties go by id, nothing is lost."""
    rows = some(300, copies=100)
    assert got(spark, rows) == plain(rows)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(120, dims=4) + [(100, None, 1), (200, [1.0, None, 2.0, 3.0], 1), (300, [nan, 1.0, 1.0, 1.0], 1), (400, [inf, 1.0, 1.0, 1.0], 2), (None, [1.0] * 4, 1), (500, [1.0] * 4, None)]
    rows += [(600, [], 1), (700, [2.0], 0), (800, [1e30, 0.0, 0.0, 0.0], 1), (900, [1e5, 1e5, 1.0, 1.0], 2), (901, [1e5, 8e4, 1.0, 1.0], 2), (902, [5e4, 5e4, 1.0, 1.0], 1), (1, [0.0] * 4, 1), (1000, [0.0] * 4, 1), (-100, [1.0, 2.0, 1.0, 1.0], 0)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    assert got(spark, [(100, [1.0], 1)]) == [] == got(spark, [(100, [1.0], 1), (101, [1.0], 1)])


def test_repeated_rows(spark):
    rows = some(60) + [some(60)[4]] * 3 + [some(60)[5]] * 2 + [(100, [1.0] * 8, 1)]
    assert got(spark, rows) == plain(rows)


def test_brackets_hold_and_rule_out():
    """No score lies outside its bracket; on clustered vectors most pairs are never compared."""
    g = np.random.default_rng(3)
    centres = g.normal(size=(12, 16)) * 300
    x = np.rint(centres[g.integers(0, 12, 4000)] + g.normal(size=(4000, 16)) * 10).astype(np.int64)
    square = (x**2).sum(axis=1)
    most = float(square.max())
    pivots = n.choose_pivots(x[:1024])
    dx = n.distances(x, square, pivots, most, False).astype("<f4").astype(float)
    dq = n.distances(x[:50], square[:50], pivots, most, True).astype("<f4").astype(float)
    low, high = n.score_bracket(dq, dx, square[:50], most)
    true = x[:50] @ x.T
    assert (low <= true).all() and (true <= high).all()
    labels = np.arange(4000) % 7
    cell = n.Cell(np.arange(50), labels[:50], x[:50], square[:50], dq, [[(n._LOW + 1, -(n._LOW + 1))]] * 50, 5, True, most)
    order = np.argsort(dx.argmin(axis=1), kind="stable")
    for at in range(0, 4000, 250):
        rows = order[at : at + 250]
        cell.tile(rows, labels[rows], x[rows], dx[rows])
    for a in range(50):
        want = sorted((-true[a, j], j) for j in range(4000) if j != a and labels[j] == labels[a])[:5]
        mine = cell.best.place == a
        assert list(zip((-cell.best.score[mine]).tolist(), cell.best.id[mine].tolist())) == want
    assert cell.compared < 0.5 * 50 * 4000 / 7
