"""Quality rules on whole texts: base counts and suffix-array repetition.

Words are runs of anything but the six ASCII white-space characters.  The
repetition rule builds a word-level suffix array of a text by prefix doubling;
its longest-common-prefix intervals of at least ``min_repeat`` words are the
maximal repeated substrings.  Their spans are joined; the rule limits the
fraction of words covered and the longest repeat.  A text in which no window of
``min_repeat`` words recurs has no such interval, so only the others are sorted.

The rule has a scale of its own: three words, where the base rule looks at
windows of five, and a higher limit, since a short text may well repeat its
title.  Stutters and short cycles, whose longest repeat is under five words,
fail it alone; so does one long passage given twice in a long text.

Memory is linear in a text: up to LEVELS words the prefix doubling keeps its
ranks (17 small arrays at most) for the prefix lengths; longer texts get them
by Kasai's rule from the suffix array, with the same result.

Defined cases: null and empty texts have no words and fail the base rule;
repeated rows keep their rows; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, own_name

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"


def word_ids(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))


_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def window_repeats(ids: np.ndarray, k: int) -> bool:
    """Whether some window of k words may occur twice; never False for one that does."""
    m = len(ids) - k + 1
    if m < 2:
        return False
    x = _mix(ids.astype(np.uint64) * _MUL + np.uint64(1))
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = h * _MUL + x[j : j + m]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


#: Words up to which the ranks of all doublings are kept.
LEVELS = 1 << 16


def _prefixes_by_levels(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of neighbours: descend the doublings, longest prefixes first."""
    n = len(sa)
    a, b, lcp = sa[:-1].copy(), sa[1:].copy(), np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        size, r = 1 << level, levels[level]
        fits = (a + size <= n) & (b + size <= n)
        same = np.zeros(n - 1, bool)
        same[fits] = r[a[fits]] == r[b[fits]]
        lcp[same] += size
        a[same] += size
        b[same] += size
    return lcp


def _prefixes_by_place(ids: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of neighbours by Kasai's rule: the next place's is at most one shorter."""
    n, h = len(sa), 0
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out, t = np.zeros(n, np.int64), ids.tolist()
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and t[i + h] == t[j + h]:
            h += 1
        out[i] = h
        h = max(h - 1, 0)
    return out[sa[1:]]


def suffix_array(ids: np.ndarray, most_kept: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array by prefix doubling, common prefix of each suffix with the one before)."""
    n = len(ids)
    rank, step, levels = ids.astype(np.int64), 1, []
    while True:
        if n <= most_kept:
            levels.append(rank.astype(np.int32))
        key = rank * (n + 2) + 1
        if step < n:
            key[:-step] += rank[step:] + 1
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank[sa] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        if rank[sa[-1]] == n - 1:
            break
        step *= 2
    return sa, _prefixes_by_levels(sa, levels) if levels else _prefixes_by_place(ids, sa)


def repeat_depths(ids: np.ndarray) -> np.ndarray:
    """Of each place, the words from there on that occur elsewhere too.

    Every suffix in an LCP interval of depth d repeats its first d words; the
    deepest interval a suffix is in is the larger prefix it shares with a neighbour.
    """
    depth = np.zeros(len(ids), np.int64)
    if len(ids) > 1:
        sa, lcp = suffix_array(ids)
        depth[sa[:-1]] = lcp
        depth[sa[1:]] = np.maximum(depth[sa[1:]], lcp)
    return depth


def words_covered(depth: np.ndarray, least: int) -> int:
    """Words inside a repeated substring of at least `least` words."""
    start = np.flatnonzero(depth >= least)
    edge = np.zeros(len(depth) + 1, np.int64)
    edge[start] += 1
    np.add.at(edge, start + depth[start], -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes | None, least: int = 3) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat."""
    if not text:
        return (0,) * 7
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, (bytes([c]) for c in SYMBOLS))), 0, 0, 0, 0)
    packed = b"".join(words)
    word_chars = len(packed) - int(np.count_nonzero((np.frombuffer(packed, np.uint8) & 0xC0) == 0x80))
    lines = text.split(b"\n")
    dup = 0
    if len(lines) > 1:
        real = [x for x in lines if x and not x.isspace()]
        dup = len(real) - len(set(real))
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    ids = word_ids(words)
    repeat = covered = longest = 0
    if window_repeats(ids, min(least, 5)):
        depth = repeat_depths(ids)
        repeat, covered, longest = words_covered(depth, 5), words_covered(depth, least), int(depth.max())
    return n, word_chars, symbols, dup, repeat, covered, longest if longest >= least else 0


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20,
    min_repeat: int = 3, max_covered: float = 0.65, max_longest: int = 50, carry: tuple[str, ...] = (), prefix: str = "",
) -> DataFrame:
    """id (and the columns in carry) with the counts, base_failed and kept.

    prefix goes before the new columns' names, for carried columns that clash.

    base_failed: under min_words words, or over max_repeat_percent of the words
    lie in five-word windows found twice.  kept: not base_failed, at most
    max_covered of the words lie in repeats of min_repeat words or more, and
    no repeat is longer than max_longest words.
    """
    # A carried text travels to Python once.
    # Names that mapInArrow takes: it resolves a.b as a field.
    safe = {c: own_name(docs, f"__c{i}") for i, c in enumerate(carry)}
    held = own_name(docs, "__text") if text_col not in carry else safe[text_col]
    extra = [] if text_col in carry else [col(text_col).cast("string").cast("binary").alias(held)]
    key = own_name(docs, "__id")
    picked = docs.select(col(id_col).alias(key), *extra, *[col(c).alias(safe[c]) for c in carry])
    keep = [f for f in picked.schema.fields if text_col in carry or f.name != held]
    made = {c: own_name(docs, "__" + c) for c in COLUMNS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(held)).cast(pa.binary())
            got = np.array([measure(texts[i].as_py(), min_repeat) for i in range(b.num_rows)], np.int64).reshape(-1, len(COLUMNS))
            own = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays(own + [pa.array(got[:, j].copy()) for j in range(len(COLUMNS))], [f.name for f in keep] + list(made.values()))

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType(keep + [StructField(c, LongType()) for c in made.values()])
    m = picked.mapInArrow(run, schema)
    n, rep, cov, longest = (F.col(made[c]) for c in ("n_words", "n_repeat_words", "n_covered", "longest_repeat"))
    failed = (n < min_words) | (100 * rep > max_repeat_percent * n)
    fine = (cov <= max_covered * n) & (longest <= max_longest)
    return m.select(
        F.col(key).alias(id_col), *[F.col(safe[c]).alias(c) for c in carry if c != id_col],
        *[F.col(made[c]).alias(prefix + c) for c in COLUMNS], failed.alias(prefix + "base_failed"), (~failed & fine).alias(prefix + "kept"),
    )
