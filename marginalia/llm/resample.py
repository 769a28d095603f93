"""Importance resampling towards a target distribution of hashed word runs.

Texts are read as Arrow's UTF-8 buffers, never as Python strings.  A table of
256 entries classifies a whole buffer's bytes (and lower-cases A-Z); word
boundaries are the places where the class, cut at the texts' ends, changes;
and the CRC-32 of all words is advanced at once: step k takes byte k of every
word that has one through the CRC table.  Words over ``STEPS`` bytes, few in
any text, go on from their state by zlib.  A run of several words goes on from
the run that is a word shorter: a blank, then the next word's bytes.

A feature's bucket is its CRC modulo ``buckets``.  Bucket counts of the corpus
and of the target texts are added up in the tasks, so a task passes on
``buckets`` rows at most, and the bucket gains that the tasks get back are as
many numbers: both are bounded by that parameter, whatever the data's size.

Of the texts of at least ``least_words`` words, ``percent`` in a hundred with the
highest scores (mean gain and Gumbel noise of the id) are drawn; ties go to the
smaller id.  Ranks need no global sort: counts per score (a score lies between
-40,000 and 63,000, as gains are logarithms of counts under 2^63 and the noise
comes from 32 bits) are added up from the top, and only rows of one score, up to
0.04 in a hundred of all by the noise's density, are sorted together.

Defined cases: null and empty texts have no features, weight 0, and a null id is
hashed as an empty string and ranks behind other ids; repeated rows are each a
row and each may be drawn, equal ids in order of their features; empty tables
give no rows (documents) or equal target counts of zero (target); extra columns
are ignored; memory is linear in the longest text, and other texts are taken in
slices of ``SLICE`` bytes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_TABLE, materialize

LOWERED = np.frombuffer(WORD_TABLE, np.uint8)
#: Bytes of words; all others stand between them.
IS_WORD = LOWERED != 32
STEPS, SLICE = 48, 1 << 22


def _crc_table() -> np.ndarray:
    """The CRC-32 table (reflected polynomial 0xEDB88320), by its rule."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


CRC_TABLE = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes start .. end of each word, all words a byte at a time."""
    state = state.copy()
    size = end - start
    order = np.argsort(-size, kind="stable")  # words that have a byte k are the first ones
    at, left, now = start[order], size[order], state[order]
    live = np.searchsorted(-left, -np.arange(STEPS), side="left")
    for k in range(STEPS):
        n = live[k]
        if not n:
            break
        now[:n] = CRC_TABLE[(now[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (now[:n] >> np.uint32(8))
    long = int(np.searchsorted(-left, -STEPS, side="left"))
    for i in range(long):  # left[i] > STEPS
        now[i] = zlib.crc32(data[at[i] + STEPS : at[i] + left[i]], int(now[i] ^ _ONES)) ^ 0xFFFFFFFF
    state[order] = now
    return state


def word_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie behind each other, each up to its place in ends."""
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = IS_WORD[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word[:-1]
    before[ends] = False  # a text's first byte opens a word
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = word[1:]
    after[ends[ends > 0] - 1] = False  # its last one closes it
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE bytes; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1, at + 1)
        yield at, to
        at = to


def features(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, bucket of each feature) of slices of a text column."""
    wide = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    held = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
    for at, to in _slices(offsets):
        ends = offsets[at : to + 1] - offsets[at]
        data = held[offsets[at] : offsets[to]]
        start, end = word_places(data, ends)
        low = LOWERED[data]
        row = np.searchsorted(ends, start, side="right") - 1
        state = advance(np.full(len(start), _ONES), low, start, end)
        rows, found = [row], [state]
        for k in range(2, longest + 1):
            n = len(start) - k + 1
            if n <= 0:
                break
            ok = np.flatnonzero(row[:n] == row[k - 1 :])  # all words of a run lie in one text
            state = CRC_TABLE[(state[:n] ^ np.uint32(32)) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
            state[ok] = advance(state[ok], low, start[ok + k - 1], end[ok + k - 1])
            rows.append(row[ok])
            found.append(state[ok])
        yield at, to - at, np.concatenate(rows), ((np.concatenate(found) ^ _ONES) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of all texts; each task passes on one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, found in features(b.column(0), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(i, 0) + 1.0) * s_all / ((corpus.get(i, 0) + 1.0) * t_all))) for i in range(buckets)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """id, n_words, n_features, weight: the floored mean of the gains of a text's features."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, row, found in features(b.column(1), longest, buckets):
                counts = np.bincount(row, minlength=n)
                total = np.bincount(row, gains[found].astype(float), n).astype(np.int64)  # exact: under 2^53
                # a text of w words has w + (w - 1) + .. features
                words = counts if longest == 1 else np.bincount(row[: _first(row)], minlength=n)
                weight = np.where(counts > 0, total // np.maximum(counts, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_words long, n_features long, weight long")


def _first(row: np.ndarray) -> int:
    """How many features are single words: they come first, in order of rows."""
    drop = np.flatnonzero(row[1:] < row[:-1])
    return int(drop[0]) + 1 if len(drop) else len(row)


def noise(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of sha256("seed:id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Adds rank: 1, 2, .. for the floor(percent N / 100) highest scores of the N eligible rows, ties to smaller ids; else null.

    scored: id, n_features, weight, score, of a written table.
    """
    width = 256
    group = F.floor(F.col("score") / width)
    counts = materialize(scored.filter(eligible).groupBy("score").agg(F.count("*").alias("c")), "resample-counts")
    # Scores have a bounded range, so there are a few hundred groups.
    groups = counts.groupBy(group.alias("g")).agg(F.sum("c").alias("c"))
    above = Window.orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns({"before": F.coalesce(F.sum("c").over(above), F.lit(0)), "drawn": F.floor(percent * F.sum("c").over(Window.partitionBy()) / 100)})
    within = Window.partitionBy("g").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("g", group).join(groups.select("g", "before", "drawn"), "g")
    placed = placed.withColumn("before", F.col("before") + F.coalesce(F.sum("c").over(within), F.lit(0))).filter("before < drawn")
    placed = materialize(placed.select("score", "before", "drawn"), "resample-places")
    cut = placed.agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.withColumn("rank", none)
    high = F.coalesce(eligible & (F.col("score") >= cut), F.lit(False))
    turn = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight"))
    rank = F.col("before") + turn
    top = scored.filter(high).join(placed, "score").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    return top.select(*scored.columns, "rank").unionByName(scored.filter(~high).select("*", none))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per document: id, n_words, n_features, weight, score, rank (null unless drawn)."""
    counted = bucket_counts(docs, text_col, longest, buckets).withColumn("side", F.lit(0)).unionByName(bucket_counts(target, target_col, longest, buckets).withColumn("side", F.lit(1)))
    sides: tuple[dict, dict] = ({}, {})
    for r in counted.collect():  # 2 x buckets rows at most
        sides[r["side"]][r["bucket"]] = r["n"]
    gains = bucket_gains(*sides, buckets)
    weighed = weigh(docs, gains, id_col, text_col, longest)
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "resample-scores")
    return draw(scored, F.col("n_words") >= least_words, percent).withColumnRenamed("id", id_col)
