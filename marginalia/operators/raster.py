"""Regions of a page by raster operations: threshold, dilation, closing, connected components.

A page is painted as grey pixels, or comes from a renderer as an array.  A pixel is
ink if it is darker than the mean of the block around it less c; ink is dilated and
closed with a square, and the boxes of the 8-connected components, in page units,
are the regions.  Sums and unions over blocks are made of those over 1, 2, 4 ...
rows and columns, so a step costs the logarithm of its block's size.

A page is a natural group: its words enter as one array of columns, and pages are
painted one at a time.  A rendered page of w x h units takes about 20 w h zoom^2 bytes
while it is worked on.  A page painted from words has two levels and is worked on as
bits, 64 pixels a step and rows that repeat the one above once: about w h zoom^2 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import columnar, list_of, list_parts

BOX = ("x0", "y0", "x1", "y1")


def paint(words, zoom: float = 2.0, margin: float = 8.0) -> np.ndarray:
    """Words (x0, y0, x1, y1; or rows of an array) as strokes on white: two of three pixel columns of each box."""
    if not len(words):
        return np.full((1, 1), 255, np.uint8)
    corners = words if isinstance(words, np.ndarray) else np.array([(w["x0"], w["y0"], w["x1"], w["y1"]) for w in words])
    boxes = np.rint(corners * zoom).astype(int)
    edge = int(margin * zoom)
    out = np.full((boxes[:, 3].max() + edge, boxes[:, 2].max() + edge), 255, np.uint8)
    strokes = np.tile(np.array([0, 0, 255], np.uint8), out.shape[1] // 3 + 1)
    for x0, y0, x1, y1 in boxes.clip(0).tolist():
        if x0 < x1:
            out[y0:y1, x0:x1] &= strokes[: x1 - x0]
    return out


def windows(a: np.ndarray, n: int, axis: int, join) -> np.ndarray:
    """join over each n values in a row along the axis: of 1, 2, 4 ... values, then what n lacks."""
    part = lambda x, s: x[s] if axis == 0 else x[:, s]
    done, out, size = 0, None, 1
    while size <= n:
        if n & size:
            # what is joined so far ends where the next part begins
            here = part(a, slice(done, done + a.shape[axis] - (n - size - done) - done))
            out = here if out is None else join(part(out, slice(0, here.shape[axis])), here)
            done += size
        a, size = join(part(a, slice(None, -size)), part(a, slice(size, None))) if 2 * size <= n else a, 2 * size
    return out


def block_sums(a: np.ndarray, before: int, after: int, mode: str = "constant") -> np.ndarray:
    """For each pixel the sum of those up to `before` above and left and `after` below and right; beyond the edge 0 or the edge's value."""
    n = before + after + 1
    # 8-bit pixels: a block's sum stays below the type's end
    padded = np.pad(a, ((before, after), (before, after)), mode=mode).astype(np.uint16 if n * n * 257 < 1 << 16 else np.uint32)
    return windows(windows(padded, n, 0, np.add), n, 1, np.add)


def ink(grey: np.ndarray, block: int = 13, c: int = 2) -> np.ndarray:
    """Pixels not lighter than the mean of the block around them less c."""
    r = block // 2
    sums = block_sums(grey, r, r, "edge")
    if 0 <= c <= 2:
        return (grey.astype(sums.dtype) + sums.dtype.type(c)) * sums.dtype.type(block * block) <= sums
    return grey.astype(np.int64) * block * block <= sums.astype(np.int64) - c * block * block


def _spread(mask: np.ndarray, before: int, after: int) -> np.ndarray:
    padded = np.pad(mask, ((before, after), (before, after)))
    for axis in (0, 1):
        padded = windows(padded, before + after + 1, axis, np.logical_or)
    return padded


def dilate(mask: np.ndarray, size: int = 8) -> np.ndarray:
    return _spread(mask, size // 2, size - 1 - size // 2)


def erode(mask: np.ndarray, size: int = 8) -> np.ndarray:
    """The dilation of what isn't set, by the mirrored square, taken away; beyond the edge all is set."""
    return ~_spread(~mask, size - 1 - size // 2, size // 2)


def component_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1; ends exclusive) of the 8-connected components, by y0, x0."""
    return [tuple(b) for b in _component_boxes(mask).tolist()]


def _component_boxes(mask: np.ndarray) -> np.ndarray:
    """component_boxes as rows: runs of a row are joined to those of the row above that they touch."""
    wide = mask.shape[1] + 2
    flat = np.pad(mask, ((0, 0), (1, 1))).ravel()
    at = np.flatnonzero(flat[1:] != flat[:-1])
    start, end = at[::2], at[1::2]
    if not len(start):
        return np.zeros((0, 4), int)
    y, x0 = np.divmod(start, wide)
    x1 = end - y * wide
    # of the row above: the first run that ends at our start or later, to the last that starts at our end or before
    first, last = np.searchsorted(end, start - wide, side="left"), np.searchsorted(start, end - wide, side="right")
    many = np.maximum(last - first, 0)
    low = np.repeat(np.arange(len(start)), many)
    up = np.arange(len(low)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    root = np.arange(len(start))
    while len(low):
        a, b = root[low], root[up]
        apart = a != b
        if not apart.any():
            break
        low, up, a, b = low[apart], up[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    order = np.argsort(root, kind="stable")
    cuts = np.flatnonzero(np.diff(root[order], prepend=-1))
    least, most = (lambda v: np.minimum.reduceat(v[order], cuts)), (lambda v: np.maximum.reduceat(v[order], cuts))
    boxes = np.stack([least(x0), least(y), most(x1), most(y + 1)], axis=1)
    return boxes[np.lexsort(boxes[:, [2, 3, 0, 1]].T)]


def page_regions(grey: np.ndarray, zoom: float = 2.0, block: int = 13, c: int = 2, size: int = 8, least: float = 8.0) -> list[tuple[float, float, float, float]]:
    """Regions of a grey page in page units, at least half of `least` wide and high."""
    mask = dilate(ink(grey, block, c), size)
    mask = erode(dilate(mask, size), size)
    return [tuple(b) for b in _large(_component_boxes(mask), zoom, least).tolist()]


def _large(boxes: np.ndarray, zoom: float, least: float) -> np.ndarray:
    boxes = boxes / zoom
    return boxes[(boxes[:, 2:] - boxes[:, :2] >= least / 2).all(axis=1)]


# Rows of bits: 64 pixels a number, lowest first; a number before the page's first
# and one behind its last are beyond the edge.
SIDE = 64


def _packed(rows: np.ndarray) -> np.ndarray:
    return np.packbits(rows, axis=-1, bitorder="little").view("<u8")


def _ahead(a: np.ndarray, n: int) -> np.ndarray:
    """At each pixel the one n to the right."""
    if not n:
        return a
    out = a >> np.uint64(n)
    out[..., :-1] |= a[..., 1:] << np.uint64(64 - n)
    return out


def _behind(a: np.ndarray, n: int) -> np.ndarray:
    """At each pixel the one n to the left."""
    if not n:
        return a
    out = a << np.uint64(n)
    out[..., 1:] |= a[..., :-1] >> np.uint64(64 - n)
    return out


def _across(a: np.ndarray, n: int, join) -> np.ndarray:
    """windows() along rows of bits: at each pixel the join over it and the n - 1 to its right, each once."""
    done, out, size = 0, None, 1
    while size <= n:
        if n & size:
            here = _ahead(a, done)
            out = here if out is None else join(out, here)
            done += size
        a, size = join(a, _ahead(a, size)) if 2 * size <= n else a, 2 * size
    return out


def _counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(at least one, at least two) of two sets of pixels together."""
    out = a | b
    out[1] |= a[0] & b[0]
    return out


def _bands(a: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one above, and the end."""
    return np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]).any(axis=1)) + 1, [len(a)]])


def _spread_bits(a: np.ndarray, before: int, after: int, inside: np.ndarray) -> np.ndarray:
    """_spread of rows of bits."""
    at, n = _bands(a), before + after + 1
    wide = _behind(_across(a[at[:-1]], n, np.bitwise_or), before) & inside
    padded = np.zeros((len(a) + n - 1, a.shape[1]), a.dtype)
    padded[before : before + len(a)] = np.repeat(wide, np.diff(at), axis=0)
    return windows(padded, n, 0, np.bitwise_or)


def painted_regions(corners: np.ndarray, zoom: float = 2.0, margin: float = 8.0, least: float = 8.0) -> np.ndarray:
    """page_regions (as rows) of the page that paint() makes of the words' boxes, by bits.

    Ink by a block of 13 x 13 and c = 2: with pixels of 0 and 255 a black one is ink if
    two in its block are white (255 x 1 < 2 x 169 <= 255 x 2), a white one never is.
    """
    if not len(corners):
        return np.zeros((0, 4))
    r, size = 6, 8
    boxes, edge = np.rint(corners * zoom).astype(int), int(margin * zoom)
    high, wide = int(boxes[:, 3].max()) + edge, int(boxes[:, 2].max()) + edge
    x0, y0, x1, y1 = boxes.clip(0).T
    use = (x0 < x1) & (y0 < y1)
    if not use.any():
        return np.zeros((0, 4))
    x0, y0, x1, y1 = x0[use], y0[use], x1[use], y1[use]
    # words of the same top and bottom are one line
    tops, line = np.unique(y0 * (high + 1) + y1, return_inverse=True)
    tops, n = np.stack(np.divmod(tops, high + 1), axis=1), x1 - x0
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    black = np.zeros((len(tops), 2 * SIDE + -(-wide // 64) * 64), bool)
    ink_at = step % 3 < 2
    black[np.repeat(line, n)[ink_at], (np.repeat(x0, n) + step)[ink_at] + SIDE] = True
    # beyond the edge are the edge's pixels
    black[:, SIDE - r : SIDE], black[:, SIDE + wide : SIDE + wide + r] = black[:, SIDE : SIDE + 1], black[:, SIDE + wide - 1 : SIDE + wide]
    place = np.arange(black.shape[1]) - SIDE
    inside, around = _packed((place >= 0) & (place < wide)), _packed((place >= -r) & (place < wide + r))
    lines, at = _packed(black), np.unique(np.concatenate([[0, high], tops.ravel()]))
    rows = np.zeros((len(at) - 1, lines.shape[1]), lines.dtype)
    for one, s, e in zip(lines, *np.searchsorted(at, tops).T.tolist()):
        rows[s:e] |= one
    white = np.zeros((2, *rows.shape), rows.dtype)
    white[0] = ~rows & around
    near = _behind(_across(white, 2 * r + 1, _counts), r)
    own = np.repeat(np.arange(len(rows)), np.diff(at))
    near = windows(near[:, own[np.arange(-r, high + r).clip(0, high - 1)]], 2 * r + 1, 1, _counts)
    mask = (rows & inside)[own] & near[1]
    # two dilations in a row are one of both reaches
    before, after = size // 2, size - 1 - size // 2
    mask = _spread_bits(mask, 2 * before, 2 * after, inside)
    mask = ~_spread_bits(~mask & inside, after, before, inside) & inside
    at = _bands(mask)
    found = _component_boxes(np.unpackbits(mask[at[:-1]].view(np.uint8), axis=1, bitorder="little")[:, SIDE : SIDE + wide].astype(bool))
    found[:, 1::2] = at[found[:, 1::2]]
    return _large(found, zoom, least)


def _regions_udf(zoom: float):
    @columnar(f"array<struct<{', '.join(f'{c}:double' for c in BOX)}>>")
    def run(pages: pa.Array) -> pa.Array:
        bounds, columns = list_parts(pages)
        corners = np.stack([columns[c].to_numpy(zero_copy_only=False) for c in BOX], axis=1)
        found = [painted_regions(corners[s:e], zoom) for s, e in zip(bounds, bounds[1:])]
        flat = np.concatenate([*found, np.zeros((0, 4))])
        return list_of([len(f) for f in found], {c: pa.array(flat[:, i]) for i, c in enumerate(BOX)})

    return run


def raster_regions(words: DataFrame, doc: str = "doc_id", page: str = "page", zoom: float = 2.0) -> DataFrame:
    """doc, page, region (from 0, by y0 and x0), x0, y0, x1, y1 of pages painted from word boxes."""
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = words.repartition(tasks, doc, page).groupBy(doc, page).agg(F.collect_list(box).alias("w"))
    return pages.select(doc, page, F.posexplode(_regions_udf(zoom)(F.col("w"))).alias("region", "b")).select(doc, page, "region", "b.*")
