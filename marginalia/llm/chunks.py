"""Substring deduplication by content-defined chunking.

A 32-bit gear hash rolls over the UTF-8 bytes (h = 2 h + gear[byte], so a byte
is forgotten after 32 steps).  A place is a boundary if its hash is the
smallest within ``reach`` bytes on both sides.  That depends only on nearby
bytes, so an insertion moves the boundaries around itself and no others, two
boundaries are more than ``reach`` bytes apart, and any passage that two texts
share gives the same chunks inside it.  Boundaries move on to the next start of
a code point; a chunk longer than ``longest`` bytes is cut every ``longest``.

Chunks are deduplicated by a 128-bit digest: digests are aggregated (combined
on the map side) to the first and last holder, and occurrences are joined to
the digests that occur more than once, in one document or several.  Neighbouring
repeated chunks of a document form runs.  The chunks at a passage's ends hang
over them and are no repeats, so a run is extended, character by character, by
what stands before (behind) it in common with the first other occurrence of its
first (last) chunk.  That is always less than the next chunk and ``reach`` + 4
bytes, backwards less than the way to the last cut that the text makes (not
``longest``), ``reach`` and the 32 bytes of a hash: were more in common, that cut,
which depends on no more, would be in both texts, and those from there to the
run too, so its neighbour were a repeat.  So this much text is compared, however
long it is, and nothing is cut off.  Runs of then under ``least`` bytes are chance and dropped.  A run is
cut into parts where its chunks start or cease to be later occurrences inside
the document.

Text of a short period has cuts every ``longest`` bytes only, which an insertion
before it does move: there a passage may be found in parts.

Defined cases: null and empty texts have no chunks; a document is an id with a
text: repeated rows are one document, and rows of one id with different texts
are several, told apart by ``version`` (a hash of the text); rows with a null
id are left out (a result carries ids); an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _gear() -> np.ndarray:
    """256 fixed pseudo-random words by a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte, by doubling: sums of 1, 2, 4 .. 32 bytes."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of h[i : i + width] for each full window, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def boundaries(data: np.ndarray, reach: int = 28, longest: int = 1024) -> np.ndarray:
    """Cut places, 0 and the length included."""
    return cut_places(data, reach, longest)[0]


def cut_places(data: np.ndarray, reach: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(all cut places, those that the text makes: not by ``longest``), 0 and the length included."""
    n = len(data)
    cuts = np.zeros(0, np.int64)
    if n > 2 * reach + 1:
        h = gear_hashes(data)
        least = _sliding_min(h, reach)  # least[i]: over i .. i + reach - 1
        p = np.arange(reach, n - reach)
        # strictly below all before, not above any after: of equal neighbours the first
        own = h[p]
        p = p[(own < least[p - reach]) & (own <= least[p + 1])]
        cuts = p + 1
        for _ in range(3):
            inside = cuts < n
            cuts[inside] += (data[cuts[inside]] & 0xC0) == 0x80
        cuts = cuts[cuts < n]
    own = cuts = np.unique(np.r_[0, cuts, n])
    gaps = np.diff(cuts)
    if (gaps > longest).any():
        more = [np.arange(a + longest, b, longest) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > longest]
        extra = np.concatenate(more)
        for _ in range(3):
            inside = extra < n
            extra[inside] += (data[extra[inside]] & 0xC0) == 0x80
        cuts = np.unique(np.r_[cuts, extra[extra < n]])
    return cuts, own


CHUNK = "id long, version long, hi long, lo long, start int, end int, n_bytes int, before int, after int"


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, version, text of rows with an id."""
    text = F.col(text_col).cast("string")
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 28, longest: int = 1024) -> DataFrame:
    """One row per chunk: document (id, version), digest (hi, lo), code-point span, bytes, bytes back to the last cut that the text makes and of the chunk after (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, versions, digests, *numbers):
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            cols = [np.concatenate(ids), np.concatenate(versions), np.ascontiguousarray(d[:, 0]), np.ascontiguousarray(d[:, 1]), *map(np.concatenate, numbers)]
            types = [pa.int64()] * 4 + [pa.int32()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "version", "hi", "lo", "start", "end", "n_bytes", "before", "after"])

        for b in batches:
            key, version, col = b.column(0), b.column(1), b.column(2)
            held = [[] for _ in range(8)]
            for i in range(b.num_rows):
                text = col[i].as_py()
                if not text:
                    continue
                data = np.frombuffer(text, np.uint8)
                cuts, own = cut_places(data, reach, longest)
                at = cuts.tolist()
                n = len(at) - 1
                points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][cuts]
                held[0].append(np.full(n, key[i].as_py(), np.int64))
                held[1].append(np.full(n, version[i].as_py(), np.int64))
                held[2] += [hashlib.blake2b(text[s:e], digest_size=16).digest() for s, e in zip(at, at[1:])]
                sizes = np.diff(cuts)
                for place, values in ((3, points[:-1]), (4, points[1:]), (5, sizes), (6, np.r_[0, cuts[1:-1] - own[np.searchsorted(own, cuts[1:-1]) - 1]]), (7, np.r_[sizes[1:], 0])):
                    held[place].append(values)
                if len(held[2]) > 50_000:
                    yield out(*held)
                    held = [[] for _ in range(8)]
            if held[2]:
                yield out(*held)

    return _documents(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, CHUNK)


def in_common(a: str, b: str, from_end: bool) -> str:
    """Longest common prefix of a and b, or suffix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :] if from_end else a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return a[len(a) - lo :] if from_end else a[:lo]


def _extensions(docs: DataFrame, runs: DataFrame, known: DataFrame) -> DataFrame:
    """id, version, run, left, right (code points) and more (bytes) by which a run goes on at its ends; known: hi, lo, first (a) and last (b) occurrence.

    Only ends inside the text are asked for; a run that is the whole text has no row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, places in enumerate(b.column(3).to_pylist()):
                key, text = (b.column(0)[i].as_py(), b.column(1)[i].as_py()), b.column(2)[i].as_py()
                for p in places:
                    at, size = p["place"], p["size"]
                    rows.append((*key, p["side"], at, text[at : at + size] if p["side"] else text[max(0, at - size) : at]))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "version", "side", "place", "around"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side, x, y = (b.column(i).to_pylist() for i in (3, 4, 5))
            same = [in_common(p, q, not s) for s, p, q in zip(side, x, y)]
            sizes = [pa.array([len(t) for t in same], pa.int32()), pa.array([len(t.encode()) for t in same], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + sizes, ["id", "version", "run", "side", "chars", "bytes"])

    # Each end's chunk, and that chunk's first and last occurrence: one of them is another one.
    head, tail = (F.struct(F.lit(side).alias("side"), f"{c}.hi", f"{c}.lo", F.col(f"{c}.start").alias("own"), place.alias("place"), F.col(size).alias("size")) for side, c, place, size in ((0, "head", F.col("start"), "left_most"), (1, "tail", F.col("end"), "right_most")))
    ends = runs.select("id", "version", "run", F.inline(F.array(head, tail))).filter("size > 0")
    is_a = (F.col("a.id") == F.col("id")) & (F.col("a.version") == F.col("version")) & (F.col("a.start") == F.col("own"))
    asked = ends.join(known, ["hi", "lo"]).withColumn("o", F.when(is_a, F.col("b")).otherwise(F.col("a")))
    there = F.when(F.col("side") == 0, F.col("o.start")).otherwise(F.col("o.end"))
    asked = asked.select("id", "version", "run", "side", "place", "size", F.col("o.id").alias("y_id"), F.col("o.version").alias("y_version"), there.alias("y_place"), F.when(F.col("side") == 0, F.col("o.left_most")).otherwise(F.col("o.right_most")).alias("y_size"))
    asked = materialize(asked.filter("y_size > 0"), "chunks-ends")
    places = asked.select("id", "version", "side", "place", "size").unionByName(asked.select(F.col("y_id").alias("id"), F.col("y_version").alias("version"), "side", F.col("y_place").alias("place"), F.col("y_size").alias("size")))
    wanted = places.groupBy("id", "version").agg(F.collect_set(F.struct("side", "place", "size")).alias("places"))
    texts = _documents(docs, id_col="id", text_col="text").join(wanted, ["id", "version"])
    around = texts.select("id", "version", "text", "places").mapInArrow(cut, "id long, version long, side int, place int, around string")
    # A plain table on this side lets adaptive execution split a holder that many runs ask for.
    around = materialize(around.dropDuplicates(["id", "version", "side", "place"]), "chunks-around")
    mine = asked.drop("size", "y_size").join(around.withColumnRenamed("around", "x"), ["id", "version", "side", "place"])
    other = around.select(F.col("id").alias("y_id"), F.col("version").alias("y_version"), "side", F.col("place").alias("y_place"), F.col("around").alias("y"))
    both = mine.join(other, ["y_id", "y_version", "side", "y_place"]).select("id", "version", "run", "side", "x", "y")
    got = both.mapInArrow(compare, "id long, version long, run long, side int, chars int, bytes int")
    on = lambda side, col: F.max(F.when(F.col("side") == side, F.col(col)).otherwise(0))
    return got.groupBy("id", "version", "run").agg(on(0, "chars").alias("left"), on(1, "chars").alias("right"), (on(0, "bytes") + on(1, "bytes")).alias("more"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 28, longest: int = 1024, least: int = 100) -> DataFrame:
    """Passages that occur again, in other documents or in this one.

    One row per part of a run: id, version, start, end (code points), n_chunks,
    n_bytes (of the chunks), first_ids (ids that hold these chunks first,
    distinct), is_first (this id is the first holder of all of them: it keeps its
    text unless again), again (the id itself holds these chunks earlier).
    """
    rows = materialize(chunks(docs, id_col, text_col, reach, longest), "chunks")
    # The most text that can go on before and behind a chunk at a run's end.
    left_most = F.when(F.col("before") > 0, F.col("before") + reach + 36).otherwise(0).alias("left_most")
    right_most = F.when(F.col("after") > 0, F.col("after") + reach + 4).otherwise(0).alias("right_most")
    lows = [f(c).alias(f"{n}_{c}") for c in ("id", "version", "start") for n, f in (("low", F.min), ("high", F.max))]
    shared = rows.groupBy("hi", "lo").agg(*lows).filter("low_id < high_id or low_version < high_version or low_start < high_start")
    shared = materialize(shared.select("hi", "lo", F.col("low_id").alias("first_id"), F.col("high_id").alias("last_id")), "chunks-shared")
    hits = rows.join(shared, ["hi", "lo"]).select("id", "version", "hi", "lo", "start", "end", "n_bytes", left_most, right_most, "first_id", "last_id")
    hits = written = materialize(hits, "chunks-hits")
    drop_table(rows)
    drop_table(shared)
    # The first and last occurrence lie in the first and last holder: a digest has few rows there, however many hold it.
    place = F.struct("id", "version", "start", "end", "left_most", "right_most")
    ends = hits.filter("id = first_id or id = last_id").groupBy("hi", "lo").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    hits = hits.drop("last_id")
    # All windows lie within an id, so one shuffle serves them.
    hits = hits.repartition("id").dropDuplicates(["id", "version", "start"])
    again = F.row_number().over(Window.partitionBy("id", "hi", "lo").orderBy("version", "start")) > 1
    w = Window.partitionBy("id", "version").orderBy("start")
    hits = hits.withColumn("again", again).withColumn("new", (F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(-1))).cast("int"))
    hits = hits.withColumn("turn", F.when(F.col("again") != F.lag("again").over(w), 1).otherwise(F.col("new")))
    hits = hits.withColumns({"run": F.sum("new").over(w), "part": F.sum("turn").over(w)}).drop("new", "turn")
    # Parts, then their runs, of the same partitioning.
    end_chunk = F.struct("start", "hi", "lo", "end", "left_most", "right_most")
    parts = hits.groupBy("id", "version", "run", "part").agg(
        F.min(end_chunk).alias("head"), F.max(end_chunk).alias("tail"), F.count("*").alias("n_chunks"), F.sum("n_bytes").alias("n_bytes"),
        F.array_sort(F.collect_set("first_id")).alias("first_ids"), F.bool_and(F.col("first_id") == F.col("id")).alias("is_first"), F.first("again").alias("again"),
    )
    parts = materialize(parts, "chunks-parts")
    runs = parts.groupBy("id", "version", "run").agg(F.min("head").alias("head"), F.max("tail").alias("tail"), F.sum("n_bytes").alias("run_bytes"))
    runs = runs.select("id", "version", "run", "head", "tail", "run_bytes", F.col("head.start").alias("start"), F.col("tail.end").alias("end"), "head.left_most", "tail.right_most")
    runs = materialize(runs.filter(F.col("run_bytes") + F.col("left_most") + F.col("right_most") >= least), "chunks-runs")
    same = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = _extensions(same, runs, ends)
    drop_table(written)
    ended = runs.join(more, ["id", "version", "run"], "left").na.fill(0, ["left", "right", "more"]).filter(F.col("run_bytes") + F.col("more") >= least)
    ended = ended.select("id", "version", "run", F.col("start").alias("run_start"), F.col("end").alias("run_end"), "left", "right")
    out = parts.join(ended, ["id", "version", "run"])
    start = F.when(F.col("head.start") == F.col("run_start"), F.col("head.start") - F.col("left")).otherwise(F.col("head.start"))
    end = F.when(F.col("tail.end") == F.col("run_end"), F.col("tail.end") + F.col("right")).otherwise(F.col("tail.end"))
    return out.select(F.col("id").alias(id_col), "version", start.alias("start"), end.alias("end"), "n_chunks", "n_bytes", "first_ids", "is_first", "again")
