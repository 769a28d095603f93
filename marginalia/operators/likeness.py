"""difflib's ratio of many pairs of texts, and the block of a cell that a scan for a quote settles on.

Pairs are columns: numpy bounds and matches those of many quotes and cells
together, so that no quote costs a call for each of its blocks.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .folds import _points, bit_places, class_counts, common_subsequence, count_bound

#: Characters and pairs of equal characters of one step of met(); two texts with more than MOST_SPOTS go to difflib.
STEP_CHARS, STEP_SPOTS, MOST_SPOTS = 1 << 18, 1 << 17, 1 << 20
#: Pairs of one step of bounds; texts and their characters that are held together, unless one cell has more, and bits of a length's q-grams.
STEP_PAIRS, HELD_TEXTS, HELD_CHARS, HELD_BITS = 1 << 17, 1 << 12, 1 << 20, 1 << 30
#: Length from which difflib's autojunk leaves frequent characters out.
JUNK = 200


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive parts of these sizes of up to so much in all, or of one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def most_kept(length: np.ndarray) -> np.ndarray:
    """How often a text of this length may have a character that autojunk leaves in."""
    return np.where(length >= JUNK, length // 100 + 1, length)


def _run_on(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, room: np.ndarray, step: int, part: np.ndarray | None = None) -> np.ndarray:
    """How many characters from places i and j on (step 1 or -1) are equal, and in part of a, at most room."""
    out, left, k = np.zeros(len(i), np.int64), np.arange(len(i)), 0
    while len(left := left[room[left] > k]):
        at = i[left] + k * step
        same = a[at] == b[j[left] + k * step]
        left, k = left[same if part is None else same & part[at]], k + 1
        out[left] = k
    return out


def _around(a, b, pair, i, j, size, a0, n, b0, m) -> tuple[np.ndarray, np.ndarray]:
    """How far equal characters go on before and behind runs.

    Runs of one diagonal are asked up to the next, and those that meet share
    their ends, so that a long stretch of equal characters is read once.
    """
    by = np.lexsort((i, j - i, pair))
    pair, i, j, size = pair[by], i[by], j[by], size[by]
    same = (pair[1:] == pair[:-1]) & (j[1:] - i[1:] == j[:-1] - i[:-1])
    room = np.minimum(a0[pair] + n[pair] - i, b0[pair] + m[pair] - j) - size
    room[:-1][same] = (i[1:] - i[:-1] - size[:-1])[same]
    on = _run_on(a, b, i + size, j + size, room, 1)
    meet = same & (on[:-1] == room[:-1])
    first, last = np.append(True, ~meet)[: len(i)], np.append(~meet, True)[: len(i)]
    room = np.minimum(i - a0[pair], j - b0[pair])
    room[1:][same] = (i[1:] - i[:-1] - size[:-1])[same]
    begin = (i - _run_on(a, b, i - 1, j - 1, np.where(first, room, 0), -1))[first]
    end, chain = (i + size + on)[last], np.cumsum(first) - 1
    out = np.empty((2, len(i)), np.int64)
    out[:, by] = i - begin[chain], end[chain] - i - size
    return out[0], out[1]


def _rounds(pair, i, j, size, back, on, a0, n, b0, m, start) -> np.ndarray:
    """Characters in the blocks of each pair, given its runs: place, size, and how far equal characters go on before and behind.

    A round settles a block of each stretch: its longest run, the first in a, then
    in b, with the equal characters around it; start is what the texts begin with
    in common, a stretch's block if it has no run.  Other runs go over to the
    stretch before or behind the block, cut to it, or end; none reaches into both,
    as none is longer than the block.
    """
    out = np.zeros(len(n), np.int64)
    who, al, ah, bl, bh = np.arange(len(n)), a0, a0 + n, b0, b0 + m
    at = pair
    while len(who):
        cut = np.maximum(np.maximum(al[at] - i, bl[at] - j), 0)
        end = np.minimum(np.minimum(ah[at] - i, bh[at] - j), size)
        some = end > cut
        pair, at, cut, end = pair[some], at[some], cut[some], end[some]
        i, j, size, back, on = i[some] + cut, j[some] + cut, end - cut, back[some] + cut, on[some] + (size[some] - end)
        # the longest, then the first in a, then in b; places count from the pair's own begin
        key = ((np.int64(1 << 21) - size) << 42) | (i - a0[pair]) << 21 | (j - b0[pair])
        first = np.full(len(who), np.iinfo(np.int64).max)
        np.minimum.at(first, at, key)
        won = np.flatnonzero(key == first[at])
        bare = first == np.iinfo(np.int64).max
        bare &= (al == a0[who]) & (bl == b0[who])
        out[who[bare]] += np.minimum(start[who[bare]], np.minimum(ah[bare] - al[bare], bh[bare] - bl[bare]))
        s = at[won]
        before = np.minimum(np.minimum(back[won], i[won] - al[s]), j[won] - bl[s])
        x, y = i[won] - before, j[won] - before
        long = before + np.minimum(np.minimum(size[won] + on[won], ah[s] - i[won]), bh[s] - j[won])
        np.add.at(out, who[s], long)
        place = np.zeros(len(who), np.int64)
        place[s] = np.arange(len(s))
        w = place[at]
        left = (i < x[w]) & (j < y[w])
        right = (i + size > x[w] + long[w]) & (j + size > y[w] + long[w])
        at = 2 * w + right
        keep = left | right
        pair, at, i, j, size, back, on = (c[keep] for c in (pair, at, i, j, size, back, on))
        pairs = lambda u, v: np.stack([u, v], axis=1).ravel()
        who, al, ah, bl, bh = np.repeat(who[s], 2), pairs(al[s], x + long), pairs(x, ah[s]), pairs(bl[s], y + long), pairs(y, bh[s])
        # only stretches with runs, and the first of a pair
        live = np.bincount(at, minlength=len(who)) > 0
        live |= (al == a0[who]) & (bl == b0[who]) & (ah > al) & (bh > bl)
        at, (who, al, ah, bl, bh) = (np.cumsum(live) - 1)[at], (c[live] for c in (who, al, ah, bl, bh))
    return out


def _met(x: list[str], y: list[str], need: np.ndarray) -> np.ndarray:
    own: dict[str, int] = {}
    which = np.array([own.setdefault(t, len(own)) for t in y], np.int64)
    (a, sa), (b, sb) = _points(x), _points(list(own))
    n, lengths = np.diff(sa), np.diff(sb)
    a0, b0, m = sa[:-1], sb[which], lengths[which]
    # places of each character in each text of y, without those that autojunk leaves out
    row = np.repeat(np.arange(len(own)), lengths)
    key = np.sort((row << 43) | (b.astype(np.int64) << 22) | np.minimum(np.arange(len(b)) - sb[row], (1 << 22) - 1))
    held, place = key >> 22, key & ((1 << 22) - 1)
    begin = np.flatnonzero(np.diff(held, prepend=-1))
    often, known = np.diff(begin, append=len(held)), held[begin]
    kept = often <= most_kept(lengths[known >> 21])
    begin, often, known = begin[kept], often[kept], np.append(known[kept], -1)
    pair = np.repeat(np.arange(len(x)), n)
    asked = (which[pair] << 21) | a
    spot = np.searchsorted(known[:-1], asked)
    hit = known[spot] == asked
    many = np.zeros(len(a), np.int64)
    many[hit] = often[spot[hit]]
    total = np.append(0, np.cumsum(many))
    spots = total[sa[1:]] - total[sa[:-1]]
    out = np.zeros(len(x), np.int64)
    huge = (spots > MOST_SPOTS) | (np.maximum(n, m) >= 1 << 21)
    for k in np.flatnonzero(huge).tolist():
        out[k] = sum(r.size for r in difflib.SequenceMatcher(None, x[k], y[k]).get_matching_blocks())
    many[huge[pair]] = 0
    start = _run_on(a, b, a0, b0, np.where(huge, 0, np.minimum(n, m)), 1)
    for part in slices(np.where(huge, 0, spots), STEP_SPOTS):
        lo, hi = sa[part.start], sa[part.stop]
        c = many[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        p = pair[i]
        j = place[np.repeat(begin[np.minimum(spot[lo:hi], len(begin) - 1)] - (np.cumsum(c) - c), c) + np.arange(len(i))] + b0[p] if len(i) else i
        fresh = ~((i > a0[p]) & (j > b0[p]) & hit[i - 1] & (a[i - 1] == b[j - 1]))
        i, j, p = i[fresh], j[fresh], p[fresh]
        size = _run_on(a, b, i, j, np.minimum(a0[p] + n[p] - i, b0[p] + m[p] - j), 1, hit)
        back, on = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        long = np.flatnonzero(m[p] >= JUNK)
        back[long], on[long] = _around(a, b, p[long], i[long], j[long], size[long], a0, n, b0, m)
        # characters of x in any run: where there are too few, blocks aren't sought
        cover = np.bincount(i - back - lo, minlength=hi - lo + 1) - np.bincount(i + size + on - lo, minlength=hi - lo + 1)
        reached = np.append(0, np.cumsum(np.cumsum(cover) > 0))
        own_lo = a0[part] - lo
        may = (reached[own_lo + n[part]] - reached[own_lo] + start[part] >= need[part]) & ~huge[part]
        few = may[p - part.start]
        number = np.cumsum(may) - 1
        some = np.flatnonzero(may) + part.start
        if len(some):
            runs = (number[p[few] - part.start], *(v[few] for v in (i, j, size, back, on)))
            out[some] = _rounds(*runs, a0[some], n[some], b0[some], m[some], start[some])
    return out


def met(x: list[str], y: list[str], need: np.ndarray | None = None) -> np.ndarray:
    """Characters in difflib's matching blocks (with autojunk) of each pair of texts; any smaller number where they are under need.

    difflib takes the longest run of equal characters that autojunk leaves in,
    lengthens it by any equal ones, and goes on with what is left on both sides.
    Here the runs of all pairs are found first, from the places of each character.
    """
    out = np.zeros(len(x), np.int64)
    need = np.zeros(len(x), np.int64) if need is None else need
    for part in slices(np.array([len(s) + len(t) for s, t in zip(x, y)], np.int64), STEP_CHARS):
        out[part] = _met(x[part], y[part], need[part])
    return out


class Texts:
    """Different texts, with what bounds the ratio of two of them: lengths, character counts and q-grams."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.array([len(t) for t in texts], np.int64)
        parts = list(slices(self.length, HELD_CHARS))
        self.counts = np.concatenate([class_counts(texts[p]) for p in parts]).astype(np.int32)
        self.kept = np.concatenate([self._kept(p) for p in parts]).astype(np.int32)
        self.sets: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _kept(self, part: slice) -> np.ndarray:
        """class_counts of the characters that autojunk leaves in."""
        points, start = _points(self.texts[part])
        row = np.repeat(np.arange(len(start) - 1), np.diff(start))
        key = np.sort((row << 21) | points)
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        often, row, point = np.diff(begin, append=len(key)), key[begin] >> 21, key[begin] & ((1 << 21) - 1)
        often[often > most_kept(np.diff(start)[row])] = 0
        wide = self.counts.shape[1]
        return np.bincount(row * wide + point % wide, often, (len(start) - 1) * wide).reshape(-1, wide)

    def grams(self, q: int, wide: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sets of q-grams, numbered if repeated, of the texts of up to wide characters.

        Bits at up to 16 x wide places, the number of q-grams without a bit of their
        own, and each text's row; shorter texts than least x wide / 2 have none, as
        their lengths alone tell them from those longer than wide / 2.
        """
        if (q, wide) in self.sets:
            return self.sets[q, wide]
        ids = np.flatnonzero((self.length <= wide) & (self.length >= (least * wide / 2 if wide > 256 else 0)))
        places = max(64, min(16 * wide, 1 << (HELD_BITS // max(len(ids), 1)).bit_length() - 1))
        bits, lost = np.zeros((len(ids), places // 64), np.uint64), np.zeros(len(ids), np.int64)
        for part in slices(np.maximum(self.length[ids], places), 1 << 23):
            points, start = _points([self.texts[k] for k in ids[part].tolist()])
            row = np.repeat(np.arange(len(start) - 1, dtype=np.uint64), np.diff(start))[: len(points) - q + 1]
            code = points[: len(row)].astype(np.uint64)
            for k in range(1, q):
                code = code * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(row)]
            code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            inside = np.arange(len(row)) + q <= start[1:][row.astype(np.int64)]
            key = np.sort((row << np.uint64(32) | code)[inside])
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            nth = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            spread = (key & np.uint64(0xFFFFFFFF)) * np.uint64(0xD1B54A32D192ED03) + nth.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
            row, seen = (key >> np.uint64(32)).astype(np.int64), np.zeros((len(start) - 1, places), bool)
            seen[row, ((spread >> np.uint64(24)) % np.uint64(places)).astype(np.int64)] = True
            bits[part] = np.packbits(seen, axis=1).view(np.uint64)
            lost[part] = np.bincount(row, minlength=len(seen)) - np.bitwise_count(bits[part]).sum(axis=1, dtype=np.int64)
        at = np.full(len(self.texts), -1)
        at[ids] = np.arange(len(ids))
        self.sets[q, wide] = bits, lost, at
        return self.sets[q, wide]

    def bound(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Upper bound of the ratios of pairs of texts, or less than least.

        Of M characters in B blocks M - (q - 1) B q-grams at least are in common.
        Blocks lie apart, so B <= T - 2 M + 1 for T = len(a) + len(b) characters; with
        autojunk each but the first holds a character that it leaves in.
        """
        n, m = self.length[a], self.length[b]
        total = np.maximum(n + m, 1)
        out = 2.0 * np.minimum(n, m) / total
        may = np.flatnonzero(out >= least)
        for at in range(0, len(may), 4096):
            k = may[at : at + 4096]
            out[k] = count_bound(self.counts[a[k]], self.counts[b[k]], n[k] + m[k])
        may = may[out[may] >= least]
        junk, size = m[may] >= JUNK, np.maximum(np.maximum(n, m)[may], 256)
        wide = np.left_shift(1, np.ceil(np.log2(size)).astype(np.int64))
        for q, w in set(zip(np.where(junk, 3, 2).tolist(), wide.tolist())):
            bits, lost, row = self.grams(q, w, least / (2 - least) if least < 2 else 1)
            those = may[(junk == (q == 3)) & (wide == w)]
            step = max(1, (1 << 21) // w)
            for at in range(0, len(those), step):
                k = those[at : at + step]
                x, y = row[a[k]], row[b[k]]
                common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(lost[x], lost[y])
                most = (common + (q - 1) * (total[k] + 1)) // (2 * q - 1)
                if q == 3:
                    most = np.minimum(most, common + 2 * (1 + np.minimum(self.counts[a[k]], self.kept[b[k]]).sum(axis=1)))
                out[k] = np.minimum(out[k], 2.0 * most / total[k])
        return out

    def could(self, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether ratios may reach least: without autojunk, which leaves few characters, their matches are held to the longest common subsequence."""
        out, held = np.ones(len(a), bool), (-1, {}, 0)
        few = np.flatnonzero(self.length[b] < JUNK)
        for k in few[np.argsort(a[few], kind="stable")].tolist():
            if held[0] != a[k]:
                text = self.texts[a[k]]
                held = a[k], bit_places(text), len(text)
            text = self.texts[b[k]]
            out[k] = 2.0 * common_subsequence(text, held[1], held[2]) / max(held[2] + len(text), 1) >= least[k]
        return out

    def ratios(self, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
        """difflib's ratio of pairs of texts, each different pair once; any smaller number where it is under least."""
        total = self.length[a] + self.length[b]
        own, first, back = np.unique(a * len(self.texts) + b, return_index=True, return_inverse=True)
        need = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(need, back, np.ceil(least * total / 2 - 1e-6).astype(np.int64))
        x, y = ([self.texts[i] for i in s[first].tolist()] for s in (a, b))
        return np.where(total > 0, 2.0 * met(x, y, need)[back] / np.maximum(total, 1), 1.0)


def settle(held: Texts, quotes: list[int], orders: list[np.ndarray], floor: float, stop: float) -> list[tuple[int, float, bool] | None]:
    """(place in its order, score, ends) of the block a scan settles on, for each quote and the blocks it is asked of in order.

    The scan ends at the first block that contains the quote (score 1) or has a
    ratio over stop; else the earliest best ratio of at least floor wins.  Of a
    quote's blocks the one of the highest bound is compared first, then twice as
    many in each round, as long as their bound may still win.
    """
    none, texts = np.iinfo(np.int64).max, held.texts
    inside = []
    for q, order in zip(quotes, orders):
        wide = np.flatnonzero(held.length[order] >= held.length[q])
        inside.append(next((k for k, i in zip(wide.tolist(), order[wide].tolist()) if texts[q] in texts[i]), -1))
    orders = [o if k < 0 else o[:k] for o, k in zip(orders, inside)]
    sizes = np.array([len(o) for o in orders], np.int64)
    quote, ended = np.repeat(np.arange(len(quotes)), sizes), np.array(inside) >= 0
    k = np.arange(len(quote)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    a, b = np.array(quotes, np.int64)[quote], np.concatenate([*orders, np.zeros(0, np.int64)]).astype(np.int64)
    bound = held.bound(a, b, min(floor, stop))
    by = np.flatnonzero(bound >= min(floor, stop))
    by = by[np.lexsort((k[by], -bound[by], quote[by]))]
    quote, k, a, b, bound = (c[by] for c in (quote, k, a, b, bound))
    rank = np.arange(len(by)) - np.searchsorted(quote, quote)
    best, where = np.full(len(quotes), float(floor)), np.full(len(quotes), none)
    end, last = np.full(len(quotes), none), np.zeros(len(quotes))
    done, step = 0, 1
    while True:
        live = (bound > stop) & (k < end[quote]) | (bound >= best[quote]) & (end[quote] == none) & ~ended[quote]
        quote, k, a, b, bound, rank = (c[live & (rank >= done)] for c in (quote, k, a, b, bound, rank))
        if not len(quote):
            break
        now = np.flatnonzero(rank < done + step)
        least = np.where(ended[quote[now]] | (end[quote[now]] < none), stop, np.minimum(best[quote[now]], stop))
        if done:  # the first of a quote is mostly its match
            may = held.could(a[now], b[now], least)
            now, least = now[may], least[may]
        for part in slices(held.length[a[now]] + held.length[b[now]], HELD_CHARS):
            these = now[part]
            score, q, at = held.ratios(a[these], b[these], least[part]), quote[these], k[these]
            over = score > stop
            np.minimum.at(end, q[over], at[over])
            over &= at == end[q]
            last[q[over]] = score[over]
            before = best.copy()
            np.maximum.at(best, q, score)
            where[best > before] = none
            top = (score == best[q]) & (score > 0)
            np.minimum.at(where, q[top], at[top])
        done, step = done + step, 2 * step
    out: list[tuple[int, float, bool] | None] = []
    for e, s, i, w, r in zip(end.tolist(), last.tolist(), inside, where.tolist(), best.tolist()):
        out.append((e, s, True) if e < none else (i, 1.0, True) if i >= 0 else (w, r, False) if w < none else None)
    return out


def best_of_cells(cells: list[tuple], floor: float, stop: float) -> Iterator[tuple]:
    """A row for each quote with a match; cells: document, quotes (ev, hint, text), blocks (page, block, text)."""
    own: dict[str, int] = {}
    asked, quotes, orders = [], [], []
    for key, mine, rows in cells:
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        ids = np.array([own.setdefault(r[2], len(own)) for r in rows], np.int64)
        pages: dict = {}
        for i, r in enumerate(rows):
            pages.setdefault(r[0], []).append(i)
        everything, near = np.arange(len(rows)), {}
        for ev, hint, text in mine:
            if hint not in near:
                near[hint] = everything if hint is None else np.array([i for p in (hint, hint - 2, hint - 1, hint + 1, hint + 2) for i in pages.get(p, ())], np.int64)
            asked.append((key, ev, hint, rows, near[hint]))
            quotes.append(own.setdefault(text, len(own)))
            orders.append(ids[near[hint]])
    held = Texts(list(own))
    for part in slices(np.array([len(o) for o in orders], np.int64), STEP_PAIRS):
        for (key, ev, hint, rows, near), got in zip(asked[part], settle(held, quotes[part], orders[part], floor, stop)):
            if got:
                page, block, _ = rows[near[got[0]]]
                yield key, ev, page, block, got[1], got[2], 0 if hint is None else -1 if page == hint else page


def best_in_cells(floor: float, stop: float, names: list[str]):
    """A map over Arrow batches sorted by cell (document, qp, bp), its quotes (kind 0) before its blocks: a row for each quote with a match."""

    def run(batches):
        at, kinds = None, None
        cells: list[tuple] = []
        texts = chars = 0

        def found():
            cols = list(zip(*best_of_cells([c for c in cells if c[1] and c[2]], floor, stop))) or [()] * len(names)
            types = [kinds[0], kinds[4], kinds[6], kinds[7], pa.float64(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            kinds = [f.type for f in b.schema]
            for key, qp, bp, kind, ev, hint, page, block, text in zip(*(b.column(i).to_pylist() for i in range(9))):
                if (key, qp, bp) != at:
                    if texts >= HELD_TEXTS or chars >= HELD_CHARS:
                        yield found()
                        cells, texts, chars = [], 0, 0
                    at = (key, qp, bp)
                    cells.append((key, [], []))
                if kind == 0:
                    cells[-1][1].append((ev, hint, text))
                elif cells[-1][1]:
                    cells[-1][2].append((page, block, text))
                else:
                    continue
                texts, chars = texts + 1, chars + len(text)
        if cells:
            yield found()

    return run
