"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; texts link at up to four differing bits.

Covering.  Cut the fingerprint into two halves of 32 bits: one half of a linked
pair differs in at most two bits.  On 31 bits of a half the codewords of the
perfect [31,26] Hamming code are the anchors: every point lies within the
covering radius 1 of exactly one anchor.  Two points at distance two or less
have a midpoint within one bit of each, and the midpoint's anchor is within
1 + 1 of both.  So each half is replicated to every anchor within covering
radius plus its share of the threshold, two bits: 16 anchors, or the point
itself if it is a codeword (no other codeword is nearer than three).  The
anchors come from the syndrome: flip the syndrome's place, or any pair of
places whose indexes xor to it.  A fingerprint meets 32 anchors out of 2 x 2^26.

Comparison.  Only distinct fingerprints are replicated, so a group of exact
copies is one row.  Rows are dealt by anchor and sorted; a task walks the runs
of equal anchors and emits the edges of a spanning forest of each run, found by
breadth-first search over what isn't reached yet: a run of m near copies costs
about m comparisons and m - 1 edges, never all its pairs.  A run of over
``longest`` fingerprints is passed on instead of held: its anchor is cut into
blocks, and each pair of blocks is a run of its own in a second pass, so that
every pair still meets and no task holds an anchor.

Defined cases: a text without words (null, empty, blanks) has fingerprint 0 and
links like any other; fewer words than a shingle give one shingle; repeated
rows keep their rows; a null id is ignored for the component's smallest id; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialize
from .components import connected_components

HALF_MASK = 0x7FFFFFFF


def fingerprint(text: bytes | None, k: int = 4, seed: int = 42) -> int:
    """SimHash of the text's k-word shingles, repeats included."""
    import xxhash

    words = text.translate(LOWER).split() if text else ()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= k:
        return h(joined, seed)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    m = n - k + 1
    ends = (starts[k:] - 1).tolist()
    hashes = np.fromiter([h(joined[s:e], seed) for s, e in zip(starts[:m].tolist(), ends)], np.uint64, m)
    counts = np.zeros(64, np.int64)
    for at in range(0, m, 8192):
        bits = np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, fp): fp holds the 64 bits in a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fps = np.fromiter((fingerprint(texts[i].as_py(), k) for i in range(b.num_rows)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "id long, fp long")


_PAIRS = [[(i, i ^ s) for i in range(1, 32) if 0 < (i ^ s) < 32 and i < (i ^ s)] for s in range(32)]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every fingerprint and every anchor of its two halves."""
    rows, keys = [], []
    for half in (0, 1):
        x = ((fp >> np.uint64(32 * half)) & np.uint64(HALF_MASK)).astype(np.int64)
        s = np.zeros(len(x), np.int64)
        for j in range(31):  # bit j stands for place j + 1
            s ^= ((x >> j) & 1) * (j + 1)
        at = np.arange(len(x))
        tag = half << 31
        for value in range(32):
            own = at[s == value]
            if not len(own):
                continue
            flips = [0] if value == 0 else [1 << (value - 1), *((1 << (i - 1)) | (1 << (j - 1)) for i, j in _PAIRS[value])]
            for f in flips:
                rows.append(own)
                keys.append((x[own] ^ f) | tag)
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges (both fingerprints) of a spanning forest of the graph "at most `most` bits apart"."""
    out, left = [], fps
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                got = left[near]
                out += [(int(x), int(y)) for y in got]
                frontier += list(got)
                left = left[~near]
    return out


def _edges(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of all runs of equal keys."""
    cut = np.flatnonzero(np.diff(key)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(key)]
    pair = np.flatnonzero(last - first == 2)  # most runs: one comparison each, all at once
    a, b = fp[first[pair]], fp[first[pair] + 1]
    near = np.bitwise_count(a ^ b) <= most
    got = [(a[near], b[near])]
    for i in np.flatnonzero(last - first > 2):
        if e := forest(fp[first[i] : last[i]], most):
            got.append(tuple(np.array(e, np.uint64).T))
    u, v = (np.concatenate([x[i] for x in got]).view(np.int64) for i in (0, 1))
    return u, v


def compare_runs(batches: Iterator[pa.RecordBatch], most: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> edges (u, v, False), and (key, fp, True) for the rows of runs of over `longest`."""

    def out(u: np.ndarray, v: np.ndarray, late: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), late))], ["u", "v", "late"])

    held, passed = (np.zeros(0, np.int64), np.zeros(0, np.uint64)), None
    for b in batches:
        key, fp = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if passed is not None:  # a long run that earlier batches began
            n = int(np.searchsorted(key, passed, side="right"))
            yield out(key[:n], fp[:n].view(np.int64), True)
            key, fp = key[n:], fp[n:]
        if not len(key):
            continue
        passed = None
        key, fp = np.r_[held[0], key], np.r_[held[1], fp]
        cut = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        size = np.diff(cut)
        long = np.repeat(size > longest, size)
        if long.any():
            yield out(key[long], fp[long].view(np.int64), True)
        whole = np.arange(len(key)) < cut[-2]  # the last run may go on in the next batch
        if size[-1] > longest:
            passed, held = key[-1], (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        else:
            held = key[cut[-2] :], fp[cut[-2] :]
        now = whole & ~long
        if now.any():
            yield out(*_edges(key[now], fp[now], most), False)
    if len(held[0]):
        yield out(*_edges(*held, most), False)


def link(distinct: DataFrame, most: int = 4, longest: int = 8192) -> DataFrame:
    """Edges (u, v) between distinct fingerprints, enough to connect all that link.

    most is at most 5: then one half differs in at most two bits.
    """
    if most > 5:
        raise ValueError("the covering holds for at most 5 differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], ["anchor", "fp"])

    def compared(rows: DataFrame, limit: int) -> DataFrame:
        key = rows.columns[0]
        dealt = rows.repartition(key).sortWithinPartitions(key)
        return materialize(dealt.mapInArrow(lambda batches: compare_runs(batches, most, limit), "u long, v long, late boolean"), "simhash-edges")

    found = compared(distinct.select("fp").mapInArrow(spread, "anchor long, fp long"), longest)
    late = found.filter("late").select(F.col("u").alias("anchor"), F.col("v").alias("fp"))
    edges = found.filter("not late").select("u", "v")
    if late.isEmpty():
        return edges
    # Blocks of about longest / 2: each pair of blocks makes a cell.
    parts = materialize(late.groupBy("anchor").agg(F.ceil(F.count("*") * 2 / longest).cast("int").alias("parts")), "simhash-long")
    block = F.pmod(F.xxhash64("fp"), "parts").cast("int")
    other = late.join(parts, "anchor").select("anchor", "fp", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cell = F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other"))
    # Two cells whose hashes agree are one run: it costs time and no link.
    again = compared(other.select(cell.alias("cell"), "fp").distinct(), 1 << 62)
    return edges.unionByName(again.select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, most: int = 4) -> DataFrame:
    """One row per input row: id, fp, component (smallest id reachable over links)."""
    rows = materialize(fingerprints(docs, id_col, text_col, k), "simhash")
    # The smallest id of each fingerprint; a null id gives way to any other.
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = connected_components(link(distinct, most), "simhash-links")
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    small = materialize(member.groupBy("root").agg(F.min("least").alias("component")), "simhash-least")
    named = materialize(member.join(small, "root").select("fp", "component"), "simhash-components")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")
