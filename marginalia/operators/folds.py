"""Order-dependent algorithms on one group, run as Arrow functions over arrays.

Each takes the group's values in order; a group is a page or a document, never
a corpus, and enters as one array column so that no pandas group is built.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.stem import stem


def arrow(kind: str):
    """A vectorised function that becomes a pandas UDF when it is used, so that workers can import this module."""

    def make(f):
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        call.__doc__ = f.__doc__
        return call

    return make


def columnar(kind: str):
    """arrow() for functions of Arrow arrays: groups stay columns, so a batch of them takes no more than its values do."""

    def make(f):
        def call(*columns):
            return F.arrow_udf(f, kind)(*columns)

        call.__doc__, call.of_arrays = f.__doc__, f
        return call

    return make


def list_parts(lists: pa.ListArray) -> tuple[list[int], dict[str, pa.Array]]:
    """Where each list of structs begins and ends among all of them (a null list is empty), and their fields as columns."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return [0, *np.cumsum(sizes).tolist()], dict(zip([f.name for f in flat.type], flat.flatten()))


def list_of(sizes: list[int], columns: dict[str, pa.Array]) -> pa.ListArray:
    """Lists of so many structs each, of these columns."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def spans_and_parents(heights, sentinel: float = 1000.0) -> tuple[list[int], list[int]]:
    """For each height: how many smaller ones follow before the next as high; place of the last strictly higher before (-1: none).

    A height above the sentinel is never closed and keeps span 0.
    """
    n = len(heights)
    span, parent, stack = [0] * n, [-1] * n, []
    for j in range(n + 1):
        h = heights[j] if j < n else sentinel
        while stack and heights[stack[-1]] <= h:
            i = stack.pop()
            span[i] = j - i - 1
        if j < n:
            parent[j] = next((i for i in reversed(stack) if heights[i] > h), -1)
            stack.append(j)
    return span, parent


@arrow("struct<span:array<bigint>,parent:array<bigint>>")
def span_parent_udf(heights: pd.Series, orders: pd.Series) -> pd.DataFrame:
    """Spans, and the parents' order values (null without one)."""
    got = [spans_and_parents(list(h)) for h in heights]
    parents = [[None if p < 0 else int(o[p]) for p in g[1]] for g, o in zip(got, orders)]
    return pd.DataFrame({"span": [g[0] for g in got], "parent": parents})


def ratio(a: str, b: str, autojunk: bool = True) -> float:
    return difflib.SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


def common_subsequence(a: Sequence[str], places: dict[str, int], m: int) -> int:
    """Length of the longest common subsequence of a and one of m characters or words given as bit masks of their places."""
    v = full = (1 << m) - 1
    for c in a:
        if u := v & places.get(c, 0):
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def bit_places(items: Sequence[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(items):
        out[c] = out.get(c, 0) | 1 << i
    return out


CLASSES = 128


def class_counts(texts: list[str]) -> np.ndarray:
    """How often each text has characters of each class (code point modulo CLASSES): a row each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(row * CLASSES + points % CLASSES, minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES)


def count_bound(a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Upper bound of the ratio: characters in common, by class counts, over the sum of lengths."""
    return 2.0 * np.minimum(a, b).sum(axis=-1) / np.maximum(total, 1)


#: Cells of one step of matched(), and texts up to which pairs are matched together (a run and a place fit 16 bits).
STEP_CELLS, SHORT = 1 << 16, 255


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.cumsum([0, *map(len, texts)])


def _longest(pa_: np.ndarray, a0: np.ndarray, n: np.ndarray, pb: np.ndarray, b0: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest common run of each pair of stretches (at a0, n long; at b0, m long): length, places in both; the earliest in a, then in b."""
    rows, high, wide = len(n), int(n.max()), int(m.max())
    j, i = np.arange(wide)[:, None], np.arange(high)[:, None]
    # code points beyond a stretch match nothing
    b = np.where(j < m, pb[np.minimum(b0 + j, len(pb) - 1)], np.uint32(0xFFFFFFFF))
    a = np.where(i < n, pa_[np.minimum(a0 + i, len(pa_) - 1)], np.uint32(0xFFFFFFFE))
    # a run's length in the high byte, and below it how early it lies in b
    early = (255 - j).astype(np.uint16)
    run, best, end = np.zeros((wide + 1, rows), np.uint16), np.full(rows, 255, np.uint16), np.zeros(rows, np.int64)
    for k in range(high):
        run[1:] = np.where(b == a[k], run[:-1] + np.uint16(256), np.uint16(0))
        most = (run[1:] | early).max(axis=0)
        longer = most > (best | np.uint16(255))
        best[longer], end[longer] = most[longer], k
    size = (best >> np.uint16(8)).astype(np.int64)
    last = 255 - (best & np.uint16(255)).astype(np.int64)
    return size, end - size + 1, last - size + 1


def matched(x: list[str], y: list[str]) -> np.ndarray:
    """Characters in difflib's matching blocks (no autojunk) of each pair of texts of up to SHORT characters.

    All pairs go together: the longest common run of each, then of what is left
    of it on both sides, and so on.
    """
    (px, sx), (py, sy) = _points(x), _points(y)
    out = np.zeros(len(x), np.int64)
    work = np.stack([np.arange(len(x)), sx[:-1], np.diff(sx), sy[:-1], np.diff(sy)])
    while True:
        work = work[:, (work[2] > 0) & (work[4] > 0)]
        if not work.shape[1]:
            return out
        work = work[:, np.lexsort((work[2], work[4]))]
        left, at = [], 0
        while at < work.shape[1]:
            step = max(1, STEP_CELLS // int(work[4, min(at + 4096, work.shape[1]) - 1]))
            pair, a0, n, b0, m = work[:, at : at + step]
            size, i, j = _longest(px, a0, n, py, b0, m)
            np.add.at(out, pair, size)
            some = size > 0
            for part in ((pair, a0, i, b0, j), (pair, a0 + i + size, n - i - size, b0 + j + size, m - j - size)):
                left.append(np.stack(part)[:, some])
            at += step
        work = np.concatenate(left, axis=1)


def ratio_udf(floor: float, autojunk: bool = False):
    """Sequence similarity 2 M / T of two texts, null under floor.

    Length, then character counts of all pairs of a batch bound it.  Blocks of
    different pairs left are sought together, if they are short and autojunk has
    no part; for others the longest common subsequence (bit operations) bounds it
    first, a pair at a time.
    """

    @arrow("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.fillna("").tolist(), b.fillna("").tolist()
        out = np.full(len(x), np.nan)
        n, m = (np.array([len(t) for t in s], np.int64) for s in (x, y))
        may = np.flatnonzero(2.0 * np.minimum(n, m) >= floor * (n + m))
        for at in range(0, len(may), 4096):
            part = may[at : at + 4096]
            part = part[count_bound(class_counts([x[i] for i in part]), class_counts([y[i] for i in part]), n[part] + m[part]) >= floor]
            short = (np.maximum(n[part], m[part]) <= SHORT) & ((m[part] < 200) | (not autojunk))
            own: dict[tuple[str, str], int] = {}
            which = [own.setdefault((x[i], y[i]), len(own)) for i in part[short].tolist()]
            if own:
                met = matched(*map(list, zip(*own)))[which]
                total = n[part[short]] + m[part[short]]
                score = np.where(total > 0, 2.0 * met / np.maximum(total, 1), 1.0)
                out[part[short][score >= floor]] = score[score >= floor]
            places: dict[str, dict[str, int]] = {}
            for i in part[~short].tolist():
                if y[i] not in places:
                    places[y[i]] = bit_places(y[i])
                if 2.0 * common_subsequence(x[i], places[y[i]], len(y[i])) >= floor * (len(x[i]) + len(y[i])):
                    score = ratio(x[i], y[i], autojunk)
                    if score >= floor:
                        out[i] = score
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run


def cue_starts(texts: list[str], starts: list[float], ends: list[float], most: int, gap: float) -> list[int]:
    """Places that open a new cue: too late after the segment before, or too long with what the cue holds."""
    held, end, cuts = 0, 0.0, []
    for i, text in enumerate(texts):
        longer = held + 1 + len(text)
        if starts[i] - end < gap and longer < most:
            held = longer
        else:
            cuts.append(i)
            held = len(text)
        end = ends[i]
    return cuts


def cue_parts(texts: list[str], starts: list[float], ends: list[float], most: int = 120, gap: float = 1.5) -> list[tuple[float, float, str]]:
    """Segments in order joined into cues (start, end, text).

    Segments from the recording's start on belong to a cue that opens with a
    blank.  A cue whose first text is empty begins with its second segment.
    """
    bounds = [0, *cue_starts(texts, starts, ends, most, gap), len(texts)]
    out = []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        text = " " * (k == 0) + " ".join(texts[a:b])
        if a == b or not (text.strip() if b == len(texts) else text):
            continue
        first = a + 1 if k and texts[a] == "" and b - a > 1 else a
        out.append((starts[first], ends[b - 1], text.strip()))
    return out


def pack_cues(segments, most: int = 120, gap: float = 1.5) -> list[dict]:
    """cue_parts of segments (start, end, text)."""
    columns = ([s[c] for s in segments] for c in ("text", "start", "end"))
    return [dict(zip(("start", "end", "text"), c)) for c in cue_parts(*columns, most, gap)]


@columnar("array<struct<start:double,end:double,text:string>>")
def pack_cues_udf(groups: pa.Array) -> pa.Array:
    """pack_cues, a recording at a time."""
    bounds, columns = list_parts(groups)
    sizes, starts, ends, texts = [], [], [], []
    for s, e in zip(bounds, bounds[1:]):
        cues = cue_parts(*(columns[c].slice(s, e - s).to_pylist() for c in ("text", "start", "end")))
        sizes.append(len(cues))
        for a, b, t in cues:
            starts.append(a)
            ends.append(b)
            texts.append(t)
    return list_of(sizes, {"start": pa.array(starts, pa.float64()), "end": pa.array(ends, pa.float64()), "text": pa.array(texts, pa.string())})


def word_runs(x0: list, y0: list, x1: list, y1: list, wide: float, high: float) -> tuple[list[int], list, list]:
    """Words in order joined into blocks of one height: first word, right and lower edge of each block."""
    starts, right, lower, height = [], [], [], None
    for i, (a, b, c, d) in enumerate(zip(x0, y0, x1, y1)):
        if d - b == height and abs(a - right[-1]) <= wide and b - lower[-1] <= high:
            right[-1], lower[-1] = max(right[-1], c), max(lower[-1], d)
        else:
            height = d - b
            starts.append(i)
            right.append(c)
            lower.append(d)
    return starts, right, lower


def merge_words(words, wide: float, high: float) -> list[dict]:
    """Words (x0, y0, x1, y1, text) in order joined into blocks of one height."""
    x0, y0, x1, y1, text = ([w[c] for w in words] for c in ("x0", "y0", "x1", "y1", "text"))
    starts, right, lower = word_runs(x0, y0, x1, y1, wide, high)
    parts = zip(starts, [*starts[1:], len(words)], right, lower)
    return [{"x0": x0[s], "y0": y0[s], "x1": r, "y1": b, "text": " ".join(t.strip() for t in text[s:e]), "height": y1[s] - y0[s]} for s, e, r, b in parts]


@columnar("array<struct<x0:double,y0:double,x1:double,y1:double,text:string,height:double>>")
def merge_words_udf(groups: pa.Array, wide: pa.Array, high: pa.Array) -> pa.Array:
    """merge_words, a page at a time."""
    bounds, columns = list_parts(groups)
    sizes, made = [], {c: [] for c in ("x0", "y0", "x1", "y1", "text", "height")}
    for s, e, w, h in zip(bounds, bounds[1:], wide.to_pylist(), high.to_pylist()):
        x0, y0, x1, y1, text = (columns[c].slice(s, e - s).to_pylist() for c in ("x0", "y0", "x1", "y1", "text"))
        starts, right, lower = word_runs(x0, y0, x1, y1, w, h)
        text = [t.strip() for t in text]
        sizes.append(len(starts))
        made["x0"] += [x0[i] for i in starts]
        made["y0"] += [y0[i] for i in starts]
        made["x1"] += right
        made["y1"] += lower
        made["text"] += [" ".join(text[i:j]) for i, j in zip(starts, [*starts[1:], len(text)])]
        made["height"] += [y1[i] - y0[i] for i in starts]
    return list_of(sizes, {c: pa.array(v, pa.string() if c == "text" else pa.float64()) for c, v in made.items()})


def boxes_touch(a, b, h: float = 6.0, v: float = 1.0, share: float = 0.75) -> bool:
    """geometry.should_merge on tuples."""
    if a[0] >= a[2] or a[1] >= a[3] or b[0] >= b[2] or b[1] >= b[3]:
        return False
    hg, vg = max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3])
    if hg < 0 and vg < 0:
        return True
    if 0 <= hg < h and abs(a[1] + a[3] - b[1] - b[3]) < (a[3] - a[1]) + (b[3] - b[1]):
        return True
    nested = (a[0] >= b[0] and a[2] <= b[2]) or (b[0] >= a[0] and b[2] <= a[2])
    return 0 <= vg < v and (nested or max(0.0, -hg) >= share * min(a[2] - a[0], b[2] - b[0]))


def merge_boxes(boxes: list[tuple], passes: int = 6, touch=boxes_touch) -> list[tuple]:
    """Passes over the list: each box takes in every later one that touches it as it has grown."""
    for _ in range(passes):
        kept: list[tuple] = []
        rest, changed = list(boxes), False
        while rest:
            a, later = rest[0], []
            for b in rest[1:]:
                if touch(a, b):
                    a, changed = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), True
                else:
                    later.append(b)
            kept.append(a)
            rest = later
        boxes = kept
        if not changed:
            break
    return boxes


def pixels_touch(a, b, share: float = 0.1) -> bool:
    """Intersection over the smaller area is at least share."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    small = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return w > 0 and h > 0 and small > 0 and w * h / small >= share


def merge_pixels(boxes: list[tuple], passes: int = 3) -> list[tuple]:
    """Grow each box, from the top left on, until nothing more touches it; `passes` times at most."""
    for _ in range(passes):
        rest, kept, changed = sorted(boxes, key=lambda b: (b[1], b[0])), [], False
        while rest:
            a, rest = rest[0], rest[1:]
            grown = True
            while grown:
                grown, later = False, []
                for b in rest:
                    if pixels_touch(a, b):
                        a, grown, changed = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), True, True
                    else:
                        later.append(b)
                rest = later
            kept.append(a)
        boxes = kept
        if not changed:
            break
    return boxes


def _boxes_udf(merge):
    @arrow("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    def run(groups: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("x0", "y0", "x1", "y1"), b)) for b in merge([(r["x0"], r["y0"], r["x1"], r["y1"]) for r in g])] for g in groups])

    return run


merge_boxes_udf = _boxes_udf(merge_boxes)
merge_pixels_udf = _boxes_udf(merge_pixels)


_ALNUM = re.compile("[a-z0-9]+")


def rouge_l(a: str, b: str, stem=None) -> float:
    """F1 of the longest common subsequence of lower-case alphanumeric words, each through stem if one is given."""
    x, y = (_ALNUM.findall((t or "").lower()) for t in (a, b))
    if stem:
        x, y = [stem(w) for w in x], [stem(w) for w in y]
    if not x or not y:
        return 0.0
    return 2 * common_subsequence(x, bit_places(y), len(y)) / (len(x) + len(y))


def long_stem(word: str) -> str:
    """The stem of a word of over three letters."""
    return stem(word) if len(word) > 3 else word


@arrow("double")
def rouge_l_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(x, y) for x, y in zip(a, b)])


@arrow("double")
def rouge_l_stemmed_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(x, y, long_stem) for x, y in zip(a, b)])


def recursive_split(text: str, size: int = 50_000, overlap: int = 100, marks=("\n\n", "\n", " ", "")) -> list[str]:
    """Cut at the first mark that occurs, join parts up to size with up to overlap characters of the last chunk."""
    mark = next(m for m in marks if m == "" or m in text)
    finer = marks[marks.index(mark) + 1 :]
    out, fit = [], []

    def flush():
        held: list[str] = []
        total = 0
        for p in fit:
            add = len(p) + (len(mark) if held else 0)
            if held and total + add > size:
                out.append(mark.join(held).strip())
                while held and (total > overlap or total + len(p) + len(mark) > size):
                    total -= len(held[0]) + (len(mark) if len(held) > 1 else 0)
                    held.pop(0)
                add = len(p) + (len(mark) if held else 0)
            held.append(p)
            total += add
        if held:
            out.append(mark.join(held).strip())
        fit.clear()

    for part in text.split(mark) if mark else list(text):
        if len(part) <= size:
            if part or mark:
                fit.append(part)
        else:
            flush()
            out += recursive_split(part, size, overlap, finer) if finer else [part]
    flush()
    return [c for c in out if c]


def recursive_split_udf(size: int, overlap: int):
    @columnar("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        # a text at a time: of a batch only the parts are held, as a column
        made = [pa.array(recursive_split(t.as_py() or "", size, overlap), pa.string()) for t in texts]
        offsets = np.cumsum([0, *map(len, made)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(made) if made else pa.array([], pa.string()))

    return run


def sentences(text: str) -> list[str]:
    """Substitute sentence splitter: after . ! or ? and white space."""
    return [s for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if s]
