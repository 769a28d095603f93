"""Best-fit packing with certified bin counts and repacking.

A text's ids end with an end-of-text id; a text longer than a sequence is cut
into pieces of full length, of which the first may be shorter.  Pieces are
dealt to partitions by a hash, and each partition is packed by best-fit
decreasing.

Certificate: for a partition's sizes the dual feasible functions
f_t(x) = capacity if x > capacity - t, 0 if x < t, else x (and the plain sum)
each give a lower bound on the bins that any packing needs.  A partition whose
bin count equals its bound is final.  One with a gap keeps its full bins and
gives up the documents of the others; these are dealt anew over fewer
partitions, where documents of several partitions meet, and packed again.  The
rounds end when one partition is left, no partition has a gap, or repacking
saves less than ``least_gain`` of the bins given up (then the packing before
stays, if it has no more bins).  pack_certified returns the bin count and bound
of every partition of every round beside the packing.

Every partition holds at most about ``per_partition`` pieces, whatever the
input's size, so no task grows with the corpus.

Defined cases: a null text is empty and has the end id only; repeated rows are
packed each, null ids too (a row number tells them apart); ids may be any long;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import id_bytes

PIECE = "id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document, with the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = id_bytes(tokenizer_path), int(end_id).to_bytes(4, "little")
        for b in batches:
            texts, rows = b.column(1), []
            for i in range(b.num_rows):
                ids = encode(texts[i].as_py() or "") + last
                n, doc = len(ids) // 4, b.column(0)[i].as_py()
                first = n % capacity or capacity
                at, piece = 0, 0
                while at < n:
                    size = first if at == 0 else capacity
                    rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, piece = at + size, piece + 1
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, PIECE)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Largest bound over the dual feasible functions of every threshold up to half the capacity."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    weight = count * np.arange(capacity + 1)
    below, above = np.cumsum(weight), np.cumsum(count[::-1])[::-1]  # above[x]: pieces of size x or more
    best = -(-int(weight.sum()) // capacity)
    for t in range(1, capacity // 2 + 1):
        large = int(above[capacity - t + 1])
        middle = int(below[capacity - t] - below[t - 1])
        best = max(best, large + -(-middle // capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, room left in each bin)."""
    order = np.argsort(-sizes, kind="stable")
    bin_of = np.empty(len(sizes), np.int64)
    rooms: list[int] = []  # rooms that some bin has, sorted
    at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    left: list[int] = []
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        j = bisect_left(rooms, size)
        if j == len(rooms):
            b, room = len(left), capacity
            left.append(0)
        else:
            room = rooms[j]
            b = at[room].pop()
            if not at[room]:
                rooms.pop(j)
        bin_of[i] = b
        left[b] = room = room - size
        if room:
            if not at[room]:
                insort(rooms, room)
            at[room].append(b)
    return bin_of, np.array(left, np.int64)


PACKED = "row long, id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, final boolean, bins long, bound long"
_ROW = ["row", "id", "piece", "start", "length", "ids_crc32"]


def _pack_round(rows: DataFrame, parts: int, capacity: int, salt: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("length", "descending"), ("row", "ascending")]))
        sizes = t.column("length").to_numpy()
        bin_of, left = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        done = np.ones(len(left), bool) if parts == 1 or len(left) == bound else left == 0
        order = np.lexsort((np.arange(len(sizes)), bin_of))
        ends = np.cumsum(sizes[order])
        starts_of = np.r_[0, ends[:-1]]
        new = np.r_[True, bin_of[order][1:] != bin_of[order][:-1]]
        base = np.maximum.accumulate(np.where(new, starts_of, 0))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = starts_of - base
        n = len(sizes)
        for name, values in (("bin", bin_of), ("offset", offset), ("final", done[bin_of]), ("bins", np.full(n, len(left))), ("bound", np.full(n, bound))):
            t = t.append_column(name, pa.array(values))
        return t

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(run, PACKED)


def pack_certified(rows: DataFrame, capacity: int = 1024, per_partition: int = 20_000, least_gain: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(pieces() rows with sequence_id and offset, certificates: round, part, pieces, bins, bound)."""
    spark = rows.sparkSession
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    # A full piece is a sequence of its own; only the others are packed.
    full = rows.filter(F.col("length") == capacity)
    done = [full.withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})]
    rest, n = rows.filter(F.col("length") < capacity).select(*_ROW), None
    notes = [spark.createDataFrame([], "round int, part long, pieces long, bins long, bound long")]
    held, bins, r = None, None, 0  # the packing of what was given up, and its bins

    def placed(packed: DataFrame, turn: int) -> DataFrame:
        sequence = (F.lit(turn).cast("long") * F.lit(1 << 52)) + F.col("part") * F.lit(1 << 24) + F.col("bin")
        return packed.select(*_ROW, sequence.alias("sequence_id"), "offset")

    while True:
        n = rest.count()
        if not n:
            break
        packed = materialize(_pack_round(rest, max(1, -(-n // per_partition)), capacity, r), "pack-round")
        per_part = packed.groupBy("part").agg(F.count("*").alias("pieces"), F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        total, = per_part.agg(F.sum("bins")).first()
        if held is not None and total >= bins:
            done.append(placed(held, r - 1))
            break
        notes.append(per_part.select(F.lit(r).alias("round"), "part", "pieces", "bins", "bound"))
        done.append(placed(packed.filter("final"), r))
        held = packed.filter("not final")
        left = held.select("part", "bin").distinct().count()
        if left and bins is not None and bins - total < least_gain * bins:
            done.append(placed(held, r))
            break
        rest, bins, r = held.select(*_ROW), left, r + 1
    out, certificates = done[0], notes[0]
    for d in done[1:]:
        out = out.unionByName(d)
    for d in notes[1:]:
        certificates = certificates.unionByName(d)
    return out.drop("row"), certificates


def pack(rows: DataFrame, capacity: int = 1024, per_partition: int = 20_000) -> DataFrame:
    """pieces() rows with sequence_id and offset."""
    return pack_certified(rows, capacity, per_partition)[0]


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 20_000) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity, per_partition).withColumnRenamed("id", id_col)
