"""Raster regions against a plain flood fill; the radial machine on a ring."""

import random

import numpy as np
import pytest

from marginalia.operators import raster as R


def plain_regions(grey, block=13, c=2, size=8):
    h, w = grey.shape
    at = lambda y, x: int(grey[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    r = block // 2
    mask = [[int(grey[y, x]) * block * block <= sum(at(y + i, x + j) for i in range(-r, r + 1) for j in range(-r, r + 1)) - c * block * block for x in range(w)] for y in range(h)]
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    lo, hi = size // 2, size - 1 - size // 2

    def grow(m):
        return [[any(inside(y + i, x + j) and m[y + i][x + j] for i in range(-lo, hi + 1) for j in range(-lo, hi + 1)) for x in range(w)] for y in range(h)]

    def shrink(m):
        return [[all(not inside(y + i, x + j) or m[y + i][x + j] for i in range(-hi, lo + 1) for j in range(-hi, lo + 1)) for x in range(w)] for y in range(h)]

    mask = shrink(grow(grow(mask)))
    seen, out = set(), []
    for y in range(h):
        for x in range(w):
            if mask[y][x] and (y, x) not in seen:
                todo, part = [(y, x)], []
                seen.add((y, x))
                while todo:
                    p = todo.pop()
                    part.append(p)
                    for i in (-1, 0, 1):
                        for j in (-1, 0, 1):
                            q = (p[0] + i, p[1] + j)
                            if inside(*q) and mask[q[0]][q[1]] and q not in seen:
                                seen.add(q)
                                todo.append(q)
                ys, xs = [p[0] for p in part], [p[1] for p in part]
                out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return sorted(out, key=lambda b: (b[1], b[0], b[3], b[2]))


def some_words(rng, n):
    out = []
    for _ in range(n):
        x, y = rng.uniform(0, 50), rng.uniform(0, 40)
        out.append({"x0": x, "y0": y, "x1": x + rng.uniform(1, 20), "y1": y + rng.uniform(1, 8)})
    return out


def test_regions_are_a_flood_fill():
    rng = random.Random(6)
    many = 0
    for n in (0, 1, 2, 3, 4, 6):
        grey = R.paint(some_words(rng, n), zoom=1.0, margin=6)
        mask = R.dilate(R.ink(grey))
        got = R.component_boxes(R.erode(R.dilate(mask)))
        assert got == plain_regions(grey)
        many += len(got) > 1
    assert many


def test_painted_pages_are_worked_on_as_bits(monkeypatch):
    """regions of a page painted from words are those of its pixels, whatever its size, edges and overlaps; pixels aren't painted."""
    g = np.random.default_rng(5)
    pages = []
    for k in range(60):
        n = int(g.integers(1, 60))
        x, y = g.uniform(-5, (20, 60, 130, 400)[k % 4], n), g.uniform(-5, (15, 50, 300)[k % 3], n)
        pages.append(np.stack([x, y, x + g.uniform(-1, 25, n), y + g.uniform(-1, 12, n)], axis=1))
    # stacked strokes of all phases: blocks without white; a page of nothing; a row of words 40 to a line
    pages.append(np.array([(s, 0.0, 60.0 + s, 40.0) for s in (0.0, 0.5, 1.0)] + [(90.0, 0.0, 91.0, 40.0)]))
    pages += [np.array([(3.0, 3.0, 3.0, 9.0)]), np.array([(12.0 * (i % 40), 16.0 * (i // 40) + 24 * (i // 30 % 10), 12.0 * (i % 40) + 1 + i % 11, 16.0 * (i // 40) + 24 * (i // 30 % 10) + 10) for i in range(300)])]
    want = {(i, z): R.page_regions(R.paint(p, z), z) for i, p in enumerate(pages) for z in (1.0, 2.0)}
    assert sum(len(w) > 1 for w in want.values()) > 30
    assert {k: [tuple(b) for b in R.painted_regions(pages[k[0]], k[1]).tolist()] for k in want} == want
    monkeypatch.setattr(R, "paint", None)
    import pyarrow as pa

    page = pa.array([[dict(zip(R.BOX, b)) for b in pages[-1].tolist()], []])
    made = []
    monkeypatch.setattr(R, "columnar", lambda kind: lambda f: made.append(f) or f)
    R._regions_udf(2.0)
    assert made[0](page).to_pylist() == [[dict(zip(R.BOX, b)) for b in want[len(pages) - 1, 2.0]], []]


def test_components_touch_at_corners():
    for seed in range(40):
        g = np.random.default_rng(seed)
        mask = g.random((14, 17)) < 0.35
        labels, n = np.zeros(mask.shape, int), 0
        for y, x in zip(*np.nonzero(mask)):
            if labels[y, x]:
                continue
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 14 and 0 <= b < 17 and mask[a, b] and not labels[a, b]:
                    labels[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        want = []
        for k in range(1, n + 1):
            ys, xs = np.nonzero(labels == k)
            want.append((xs.min(), ys.min(), xs.max() + 1, ys.max() + 1))
        assert R.component_boxes(mask) == sorted(want, key=lambda b: (b[1], b[0], b[3], b[2]))


def test_raster_regions(spark):
    rows = [(1, 0, x, y, x + 20.0, y + 8.0) for x in (0.0, 24.0, 48.0) for y in (0.0, 10.0)] + [(1, 0, 0.0, 80.0, 60.0, 88.0), (1, 1, 5.0, 5.0, 40.0, 15.0)]
    got = R.raster_regions(spark.createDataFrame(rows, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")).collect()
    pages = {p: [r for r in got if r.page == p] for p in (0, 1)}
    assert len(pages[0]) == 2 and len(pages[1]) == 1 and [r.region for r in sorted(pages[0], key=lambda r: r.y0)] == [0, 1]
    top = min(pages[0], key=lambda r: r.y0)
    assert top.x0 <= 0.5 and top.x1 >= 68 and top.y1 >= 18 and top.y1 < 60


def test_a_ring_needs_the_radial_kernel(spark):
    from pyspark.ml import classification as c
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    from marginalia.operators.kernel import RadialMachine
    from marginalia.operators.layout import classifiers

    g = np.random.default_rng(1)
    angle, far = g.uniform(0, 6.28, 400), np.where(np.arange(400) % 2, 1.0, 3.0) + g.normal(0, 0.2, 400)
    rows = [(float(r * np.cos(a)), float(r * np.sin(a)), float(i % 2)) for i, (a, r) in enumerate(zip(angle, far))]
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame(rows, "x double, y double, label double"))
    train, test = df.limit(300).cache(), df.subtract(df.limit(300))
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    radial = ev.evaluate(RadialMachine(size=128, rounds=30).setFeaturesCol("features").setLabelCol("label").fit(train).transform(test))
    linear = ev.evaluate(c.OneVsRest(classifier=c.LinearSVC(maxIter=30)).fit(train).transform(test))
    assert radial > 0.95 and linear < 0.8
    assert len(classifiers()) == 5 and "radial_svm" in classifiers()


def test_kernel_of_the_features():
    """Inner products of the features are near the kernel."""
    pytest.importorskip("numpy")
    g = np.random.default_rng(2)
    x, gamma, size = g.normal(size=(20, 5)), 0.3, 20_000
    w, b = g.normal(0, np.sqrt(2 * gamma), (5, size)), g.uniform(0, 2 * np.pi, size)
    z = np.sqrt(2 / size) * np.cos(x @ w + b)
    want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.05
