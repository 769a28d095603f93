"""Hard negatives by a pivot table.

Vectors become integers (each component floor(scale x)).  One more component,
sqrt(M^2 - |x|^2) with M the largest norm, brings all to the length M; an
anchor q gets a zero there, and then |q' - x'|^2 = M^2 + |q|^2 - 2 <q, x>: the
inner product turns into a Euclidean distance.  Each row's distances to
``PIVOTS`` pivots are stored.  By the triangle inequality |d(q, p) - d(x, p)| and
d(q, p) + d(x, p) bracket d(q, x) for every pivot p, which brackets the score;
rows whose bracket can't reach an anchor's window, or its k-th best score so
far, are out, and the others' scores are computed exactly.

The anchors meet all rows in cells: a block of about ``BLOCK`` anchors and one of
``CELLS`` parts of the rows.  A cell streams its rows past the anchors' state (k
best each), ``TILE`` rows at a time in order of the nearest pivot, so that the
tile's own range of pivot distances rules out anchors at once.  No task holds
more than a block and a tile; a cell passes on k rows for an anchor at most; rows
are replicated once for each block of anchors, anchors CELLS times.

Two rounds: the k best rows of an anchor's own label (positives), then for each
positive the best rows of other labels in its score window (negatives).

Pivots are fitted on a bounded sample, the ``SAMPLE`` rows with the smallest hash:
the first is the farthest from the sample's mean, each next one the farthest
from those before.  Any choice gives the same rows; it only moves the brackets.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component take no part, nor do rows with a component of 2^26 or more
once floored (their scores might not fit a long); shorter vectors are padded
with zeros; repeated rows are each a row, but an anchor's own id is never its
positive; repeated anchors are one anchor for each distinct row; an anchor without
positives or negatives has no rows; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIVOTS, SAMPLE, CELLS, BLOCK, TILE = 12, 1024, 64, 8192, 4096
LARGEST = 1 << 26
_LOW = np.iinfo(np.int64).min
ROWS = "id long, label long, v binary, square long"


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of little-endian int32 components, padded with zeros to dims."""
    parts = column.to_pylist()
    sizes = np.array([len(p) // 4 for p in parts], np.int64)
    flat = np.frombuffer(b"".join(parts), "<i4")
    out = np.zeros((len(parts), dims), np.int64)
    out[np.arange(dims)[None] < sizes[:, None]] = flat
    return out


def integer_rows(table: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id, label, v (int32 components), square (the norm's) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(2)
            flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.array(held.value_lengths().fill_null(0), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(scale * flat)
                bad = ~(np.abs(whole) < LARGEST)  # null, infinite and not-a-number components too
            gone = np.bincount(row[bad], minlength=len(sizes)) > 0
            whole[bad] = 0
            ints = whole.astype("<i4")
            square = np.zeros(len(sizes), np.int64)
            np.add.at(square, row, ints.astype(np.int64) ** 2)
            at = np.r_[0, np.cumsum(sizes)]
            data = ints.tobytes()
            cols = [b.column(0), b.column(1), pa.array([data[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()), pa.array(square)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "label", "v", "square"]).filter(pa.array(~gone))

    own = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return own.filter("id is not null and label is not null and vector is not null").mapInArrow(run, ROWS)


def distances(vectors: np.ndarray, square: np.ndarray, pivots: np.ndarray, most: float, query: bool) -> np.ndarray:
    """Distances of augmented vectors (queries: with a zero) to augmented pivots of the length sqrt(most)."""
    dot = vectors.astype(float) @ pivots.astype(float).T
    if not query:
        extra = np.sqrt(np.maximum(most - square, 0.0))
        dot += extra[:, None] * np.sqrt(np.maximum(most - (pivots.astype(float) ** 2).sum(axis=1), 0.0))[None]
        return np.sqrt(np.maximum(2 * most - 2 * dot, 0.0))
    return np.sqrt(np.maximum(most + square[:, None] - 2 * dot, 0.0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first rows of a sample, from that farthest from its mean."""
    if not len(sample):
        return sample
    x = sample.astype(float)
    far = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    picked: list[int] = []
    for _ in range(min(n, len(x))):
        picked.append(int(far.argmax()))
        d = ((x - x[picked[-1]]) ** 2).sum(axis=1)
        far = d if len(picked) == 1 else np.minimum(far, d)
    return sample[picked]


def score_bracket(dq: np.ndarray, dx: np.ndarray, square: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each (anchor, row) by their pivot distances, widened by the stored distances' rounding."""
    low = np.zeros((len(dq), len(dx)))
    high = np.full((len(dq), len(dx)), np.inf)
    for j in range(dq.shape[1]):
        a, b = dq[:, j][:, None], dx[:, j][None]
        np.maximum(low, np.abs(a - b), out=low)
        np.minimum(high, a + b, out=high)
    return _scores(low, high, square[:, None], most)


def _scores(low: np.ndarray, high: np.ndarray, square: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores between the distances low and high; stored distances are rounded to 2^-24 of themselves."""
    whole = most + square
    slack = 1e-6 * whole + 1
    return (whole - high * high) / 2 - slack, (whole - low * low) / 2 + slack


class Best:
    """For each of n places the k best (score, id), by falling score, then rising id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.place, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, _LOW)  # the k-th score, once there are k

    def add(self, place: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(place):
            return
        place, score, id_ = (np.concatenate(p) for p in ((self.place, place), (self.score, score), (self.id, id_)))
        order = np.lexsort((id_, -score, place))
        place, score, id_ = place[order], score[order], id_[order]
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        turn = np.arange(len(place)) - np.repeat(new, np.diff(np.r_[new, len(place)]))
        keep = turn < self.k
        last = turn == self.k - 1
        self.floor[place[last]] = score[last]
        self.place, self.score, self.id = place[keep], score[keep], id_[keep]


def exact_scores(a: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products; by floating point where its integers hold them."""
    return (a.astype(float) @ x.astype(float).T).astype(np.int64) if most < 2**52 else a @ x.T


class Cell:
    """A block of anchors, past which rows stream.

    windows: per anchor a list of (place, least score, greatest score); a row is a
    hit of a place if its score lies in it and its label is the anchor's (same) or
    another one.
    """

    def __init__(self, ids, labels, vectors, square, dq, windows, k: int, same: bool, most: float):
        self.ids, self.labels, self.v, self.square, self.dq, self.same, self.most = ids, labels, vectors, square, dq, same, most
        n = max((len(w) for w in windows), default=0)
        self.lo = np.full((len(ids), n), 1, np.int64)
        self.hi = np.zeros((len(ids), n), np.int64)  # no window: nothing between 1 and 0
        for i, w in enumerate(windows):
            for j, (lo, hi) in enumerate(w):
                self.lo[i, j], self.hi[i, j] = lo, hi
        self.best = Best(len(ids) * n, k)
        self.compared = self.bracketed = 0

    def tile(self, ids, labels, vectors, dx) -> None:
        n = self.lo.shape[1]
        least, most_of = dx.min(axis=0), dx.max(axis=0)
        off = np.maximum(np.maximum(least[None] - self.dq, self.dq - most_of[None]), 0).max(axis=1)
        reach = (self.dq + most_of[None]).min(axis=1)
        bottom, top = _scores(off, reach, self.square, self.most)
        want = np.maximum(self.lo, self.best.floor.reshape(-1, n)).min(axis=1, initial=np.iinfo(np.int64).max, where=self.lo <= self.hi)
        some = np.where(self.lo <= self.hi, self.hi, _LOW).max(axis=1, initial=_LOW)
        live = np.flatnonzero((top >= want) & (bottom <= some))
        for at in range(0, len(live), 256):
            rows = live[at : at + 256]
            low, high = score_bracket(self.dq[rows], dx, self.square[rows], self.most)
            alike = self.labels[rows][:, None] == labels[None]
            ok = (high >= want[rows][:, None]) & (low <= some[rows][:, None]) & (alike if self.same else ~alike)
            if self.same:
                ok &= self.ids[rows][:, None] != ids[None]
            self.bracketed += ok.size
            cols = np.flatnonzero(ok.any(axis=0))
            if not len(cols):
                continue
            ok = ok[:, cols]
            self.compared += int(ok.sum())
            score = exact_scores(self.v[rows], vectors[cols], self.most)
            for j in range(n):
                place = rows * n + j
                # ties with the k-th score count: their ids decide
                hit = ok & (score >= np.maximum(self.lo[rows, j], self.best.floor[place])[:, None]) & (score <= self.hi[rows, j][:, None])
                a, x = np.nonzero(hit)
                self.best.add(place[a], score[a, x], ids[cols[x]])


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Rows and anchors of each cell together, anchors first, rows by nearest pivot."""
    cell = F.pmod(F.xxhash64("id", "v"), F.lit(CELLS)).cast("int")
    spread = rows.select("id", "label", "v", "square", "d", "near", F.lit(None).cast(anchors.schema["windows"].dataType).alias("windows"), F.lit(None).cast("long").alias("anchor"), cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = anchors.select("id", "label", "v", "square", "d", F.lit(-1.0).alias("near"), "windows", "anchor", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"), F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block"))
    both = spread.unionByName(asked).select("cell", "block", "near", "anchor", "id", "label", "v", "square", "d", "windows")
    return both.repartition("cell", "block").sortWithinPartitions("cell", "block", "near")


FOUND = "anchor long, place int, found array<struct<down:long,id:long>>"


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, same: bool, dims: int, most: float) -> DataFrame:
    """anchor, place, found: the k best (-score, id) of every window, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Cell, keys: np.ndarray) -> pa.RecordBatch:
            n = c.lo.shape[1]
            new = np.flatnonzero(np.r_[True, c.best.place[1:] != c.best.place[:-1]]) if len(c.best.place) else np.zeros(0, np.int64)
            places = c.best.place[new]
            pairs = pa.StructArray.from_arrays([pa.array(-c.best.score), pa.array(c.best.id)], ["down", "id"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(c.best.place)], pa.int32()), pairs)
            return pa.RecordBatch.from_arrays([pa.array(keys[places // max(n, 1)]), pa.array((places % max(n, 1)).astype(np.int32)), lists], ["anchor", "place", "found"])

        held: list[pa.RecordBatch] = []  # anchors of the cell at hand, until its rows begin
        at, cell, keys = None, None, np.zeros(0, np.int64)

        def open_cell() -> Cell:
            t = pa.Table.from_batches(held)
            num = lambda c: t.column(c).to_numpy()
            windows = [[(w["lo"], w["hi"]) for w in ws] for ws in t.column("windows").to_pylist()]
            d = np.frombuffer(b"".join(t.column("d").to_pylist()), "<f4").reshape(t.num_rows, -1).astype(float)
            return Cell(num("id"), num("label"), _vectors(t.column("v").combine_chunks(), dims), num("square"), d, windows, k, same, most)

        for b in batches:
            place = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
            kind = b.column(2).to_numpy() < 0
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if s == e:
                    continue
                part, here = b.slice(s, e - s), tuple(place[:, s])
                if here != at:
                    if cell is not None:
                        yield out(cell, keys)
                    at, cell, held = here, None, []
                if kind[s]:
                    held.append(part)
                    continue
                if cell is None and held:
                    cell, keys = open_cell(), pa.Table.from_batches(held).column("anchor").to_numpy()
                if cell is None:
                    continue  # no anchors in this block
                for i in range(0, part.num_rows, TILE):
                    r = part.slice(i, TILE)
                    d = np.frombuffer(b"".join(r.column(8).to_pylist()), "<f4").reshape(r.num_rows, -1).astype(float)
                    cell.tile(r.column(4).to_numpy(), r.column(5).to_numpy(), _vectors(r.column(6), dims), d)
        if cell is not None:
            yield out(cell, keys)

    found = _dealt(rows, anchors, blocks).mapInArrow(run, FOUND)
    # At most CELLS x k entries meet for a window.
    best = found.groupBy("anchor", "place").agg(F.flatten(F.collect_list("found")).alias("found"))
    return materialize(best.select("anchor", "place", F.slice(F.array_sort("found"), 1, k).alias("found")), "negatives-found")


def mine(
    table: DataFrame, label: Column, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    label: a row's label, of table's columns.  is_anchor: of id.  Negatives
    satisfy least x positive_score <= 100 x negative_score <= most x positive_score.
    """
    raw = materialize(integer_rows(table, label, id_col, vector_col, scale), "negatives-rows")
    top, size = raw.agg(F.max("square"), F.max(F.length("v"))).first()
    if top is None:
        top, size = 0, 0
    dims, longest = size // 4, float(top)
    sample = raw.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("v").collect()
    pivots = choose_pivots(_vectors(pa.array([bytes(r["v"]) for r in sample], pa.binary()), dims))

    def measured(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(at, TILE) for b in batches for at in range(0, b.num_rows, TILE)):
                d = distances(_vectors(b.column(2), dims), b.column(3).to_numpy(), pivots, longest, query).astype("<f4")
                near = pa.array(d.argmin(axis=1) + np.minimum(d.min(axis=1) / (4 * longest**0.5 + 1), 0.9))  # by nearest pivot, then distance to it
                data, width = d.tobytes(), 4 * d.shape[1]
                cols = [b.column(i) for i in range(4)] + [pa.array([data[i * width : (i + 1) * width] for i in range(b.num_rows)], pa.binary()), near.cast(pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "label", "v", "square", "d", "near"])

        return run

    shape = ROWS + ", d binary, near double"
    rows = materialize(raw.mapInArrow(measured(False), shape), "negatives-table")
    own = raw.filter(is_anchor).dropDuplicates(["id", "label", "v"]).mapInArrow(measured(True), shape)
    anchors = materialize(own.withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    blocks = max(1, -(-anchors.count() // block))
    ever = F.array(F.struct(F.lit(_LOW + 1).alias("lo"), F.lit(-(_LOW + 1)).alias("hi")))  # any score
    first = _search(rows, anchors.withColumn("windows", ever), blocks, positives, True, dims, longest)
    each = first.select("anchor", F.posexplode("found").alias("place", "p"))
    each = each.select("anchor", "place", F.col("p.id").alias("positive_id"), (-F.col("p.down")).alias("positive_score"))
    # Rounded up and down to whole scores, in integers.
    lo, hi = (F.expr(f"({c} * positive_score {sign} pmod({neg}{c} * positive_score, 100)) div 100") for c, sign, neg in ((least, "+", "-"), (most, "-", "")))
    windows = each.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", lo.alias("lo"), hi.alias("hi")))).alias("windows"))
    asked = anchors.join(windows, "anchor").withColumn("windows", F.transform("windows", lambda w: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"))))
    second = _search(rows, materialize(asked, "negatives-asked"), blocks, negatives, False, dims, longest)
    pairs = second.select("anchor", "place", F.posexplode("found").alias("at", "n")).join(each, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return pairs.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.down")).alias("negative_score"))
