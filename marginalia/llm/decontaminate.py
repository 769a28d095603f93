"""Benchmark decontamination by winnowing.

Texts become words (A-Z lower-cased).  A window is 10 consecutive words of a
benchmark item; an item of fewer words is one window.  A document word is hit
if it lies in an occurrence of a window.

Winnowing: of every ``span - k + 1`` consecutive k-gram hashes of a text the
smallest are its fingerprints (all places of the minimum, so that both sides
choose alike).  Any shared span of ``span`` words then shares a fingerprint.
Document fingerprints are joined to the items' fingerprints, and each hit is
extended: the windows around it are looked up by hash and compared word by
word.  Items shorter than a window lie below the guarantee; they are found by
their own length's hash at places that hold their first word.

Join strategy: the items' words, fingerprints and windows form an index in flat
arrays.  It is cut into blocks of whole items, each of about ``block_bytes``
(text and arrays as estimated by WORD_BYTES), which are broadcast one after the
other and the hits united; a usual benchmark is one block.  Each block is a
pass over the documents, which are not shuffled.  A benchmark of more than
``most_blocks`` blocks is not broadcast: fingerprints of documents and items
are joined as rows, the windows around the places that meet are joined to the
items' windows by 128-bit hashes, and only items shorter than a window go in
blocks as before.

Defined cases: null and empty texts have no words; an item without words has no
windows; items with equal ids are one item; repeated document rows keep their
rows; empty tables on either side give all-clean or empty results; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, col, materialize, own_name

_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word codes."""
    m = len(x) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = x[:m].copy()
    for j in range(1, k):
        h *= _P
        h += x[j : j + m]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the smallest of some `width` consecutive hashes (of all, if fewer)."""
    m = len(h) - width + 1
    if m <= 0:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    least = h[:m].copy()
    for j in range(1, width):
        np.minimum(least, h[j : j + m], out=least)
    chosen = np.zeros(len(h), bool)
    for j in range(width):
        chosen[j : j + m] |= h[j : j + m] == least
    return np.flatnonzero(chosen)


class Index:
    """Fingerprints and windows of some items: [(item_id, words)].

    Flat arrays: the items' words as numbers, strung together, and of each
    window its hash, place and item, sorted by hash: about 30 bytes a word,
    beside the words themselves.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], span: int = 10, k: int = 5):
        self.span, self.k = span, k
        self.number: dict[bytes, int] = {}
        coded = [(i, np.fromiter([self.number.setdefault(w, len(self.number) + 1) for w in ws], np.int32, len(ws))) for i, ws in items if ws]
        # code of a word number; 0 stands for every word that no item has, and for the gap between texts
        self.code = self._codes(len(self.number) + 1)
        prints, keys, places, owners, texts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
        self.items: list[int | None] = []
        short: dict[int, dict[tuple, set]] = {}
        for item, ids in coded:
            if len(ids) < span:
                short.setdefault(len(ids), {}).setdefault(tuple(ids.tolist()), set()).add(item)
                continue
            x = self.code[ids]
            h = gram_hashes(x, k)
            prints.append(h[winnow(h, span - k + 1)])
            wide = gram_hashes(x, span)
            keys.append(wide)
            places.append(np.arange(at, at + len(wide)))
            owners.append(np.full(len(wide), len(self.items), np.int32))
            texts.append(ids)
            self.items.append(item)
            at += len(ids)
        self.prints = np.unique(np.concatenate(prints))
        self.text, keys, places, owners = (np.concatenate(x) for x in (texts, keys, places, owners))
        order = np.lexsort((owners, keys))
        keys, places, owners = keys[order], places[order], owners[order]
        # an item's later places of a hash add nothing, if they hold the same words
        if len(keys):
            again = np.r_[False, (keys[1:] == keys[:-1]) & (owners[1:] == owners[:-1])]
            for i in np.flatnonzero(again).tolist():
                a, b = places[i - 1], places[i]
                again[i] = bool((self.text[a : a + span] == self.text[b : b + span]).all())
            keys, places, owners = keys[~again], places[~again], owners[~again]
        self.keys, self.places, self.owners = keys, places, owners
        self.short = {}
        for size, table in sorted(short.items()):
            first = np.zeros(len(self.number) + 1, bool)
            first[[w[0] for w in table]] = True
            self.short[size] = (first, table)

    @staticmethod
    def _codes(n: int) -> np.ndarray:
        x = np.arange(1, n + 1, dtype=np.uint64) * _P
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, frozenset]]:
        """(start, size, items) of every window occurrence in the word numbers ids."""
        out = []
        if len(self.prints):
            x = self.code[ids]
            h = gram_hashes(x, self.k)
            at = winnow(h, self.span - self.k + 1)
            if len(at):
                v = h[at]
                place = np.minimum(np.searchsorted(self.prints, v), len(self.prints) - 1)
                at = at[self.prints[place] == v]
            if len(at):
                # extend: every window that contains the fingerprint's words
                around = np.unique((at[:, None] - np.arange(self.span - self.k + 1)[None, :]).ravel())
                around = around[(around >= 0) & (around <= len(ids) - self.span)]
                if len(around):
                    wide = np.zeros(len(around), np.uint64)
                    for j in range(self.span):
                        wide *= _P
                        wide += x[around + j]
                    wide ^= wide >> np.uint64(31)
                    wide *= np.uint64(0xD6E8FEB86659FD93)
                    wide ^= wide >> np.uint64(32)
                    low, high = (np.searchsorted(self.keys, wide, side=x) for x in ("left", "right"))
                    for i in np.flatnonzero(low < high).tolist():
                        s, which = int(around[i]), np.arange(low[i], high[i])
                        same = (self.text[self.places[which][:, None] + np.arange(self.span)] == ids[s : s + self.span]).all(axis=1)
                        if same.any():
                            out.append((s, self.span, {self.items[o] for o in self.owners[which[same]].tolist()}))
        for size, (first, table) in self.short.items():
            for s in np.flatnonzero(first[ids[: len(ids) - size + 1]]).tolist() if len(ids) >= size else ():
                items = table.get(tuple(ids[s : s + size].tolist()))
                if items:
                    out.append((s, size, items))
        return out


def _scan(index: Index, texts: list[bytes | None]) -> list[tuple[int, dict[int, set] | None, list]]:
    """(n_words, hits) per text; texts are strung together with gaps and searched at once."""
    get, ids, bounds = index.number.get, [], [0]
    for t in texts:
        ids += [get(w, 0) for w in words_of(t)]
        ids += (0,)
        bounds.append(len(ids))
    found: list[list] = [[] for _ in texts]
    starts = np.array(bounds)
    got = index.hits(np.array(ids, np.int64))
    owner = np.searchsorted(starts, [s for s, _, _ in got], side="right") - 1
    for o, (s, size, items) in zip(owner.tolist(), got):
        found[o].append((s - bounds[o], size, items))
    return [(bounds[i + 1] - bounds[i] - 1, found[i]) for i in range(len(texts))]


def _slices(col: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """(first row, texts) of runs of rows with about `most` bytes each."""
    held, texts, first = 0, [], 0
    for i in range(len(col)):
        t = col[i].as_py()
        texts.append(t)
        held += len(t or b"")
        if held >= most:
            yield first, texts
            held, texts, first = 0, [], i + 1
    if texts:
        yield first, texts


#: Bytes of an index a word: 28 in arrays, and 100 for each different word (counted as a third of all).
WORD_BYTES = 64


def blocks_of(bench: DataFrame, id_col: str, text_col: str, block_bytes: int, span: int, k: int) -> Iterator[Index]:
    """Indexes of whole items, each of about block_bytes; the driver holds one at a time."""
    items = bench.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).filter("text is not null")
    held, n = [], 0
    for row in items.toLocalIterator():
        ws = words_of(bytes(row.text))
        held.append((row.id, ws))
        n += WORD_BYTES * len(ws) + len(row.text)
        if n >= block_bytes:
            yield Index(held, span, k)
            held, n = [], 0
    if held:
        yield Index(held, span, k)


def _word_codes(text: bytes | None) -> np.ndarray:
    import xxhash

    ws = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def _two_hashes(x: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    return gram_hashes(x, span).view(np.int64), gram_hashes((x ^ (x >> np.uint64(17))) * np.uint64(0xBF58476D1CE4E5B9), span).view(np.int64)


#: Stands for a null item id while rows are joined: its windows count, its id is not reported.
_NO_ID = -(1 << 63)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = pa.array([len(words_of(t.as_py())) for t in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], [*b.schema.names, "n_words"])


def join_hits(rows: DataFrame, items: DataFrame, span: int, k: int) -> DataFrame:
    """row, hit (joined spans), items of documents (row, text) against long items (item, text), by joins of rows only."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            keys, places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(b.num_rows):
                h = gram_hashes(_word_codes(b.column(1)[i].as_py()), k)
                if len(h) > span - k:
                    at = winnow(h, span - k + 1)
                    keys.append(np.full(len(at), b.column(0)[i].as_py(), np.int64))
                    places.append(at)
                    values.append(h[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, places, values)], ["row", "place", "print"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All windows of a text, or those that contain a fingerprint of the places given."""
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for i in range(b.num_rows):
                one, two = _two_hashes(_word_codes(b.column(1)[i].as_py()), span)
                at = np.arange(len(one))
                if b.num_columns > 2:
                    near = np.array(b.column(2)[i].as_py(), np.int64)
                    at = np.unique((near[:, None] - np.arange(span - k + 1)[None, :]).ravel())
                    at = at[(at >= 0) & (at < len(one))]
                for held, x in zip(out, (np.full(len(at), b.column(0)[i].as_py(), np.int64), at, one[at], two[at])):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["row", "s", "one", "two"])

    found, cut = "row long, place long, print long", "row long, s long, one long, two long"
    known = items.select("item", "text").mapInArrow(prints, found).select("print").distinct()
    met = rows.select("row", "text").mapInArrow(prints, found).join(materialize(known, "decontaminate-prints"), "print", "left_semi")
    places = materialize(met.groupBy("row").agg(F.collect_set("place").alias("places")), "decontaminate-places")
    mine = rows.join(places, "row").select("row", "text", "places").mapInArrow(windows, cut)
    theirs = items.select("item", "text").mapInArrow(windows, cut).select("one", "two", F.col("row").alias("item")).distinct()
    hits = mine.join(materialize(theirs, "decontaminate-windows"), ["one", "two"])
    spans = F.transform(F.array_sort(F.collect_set("s")), lambda x: F.struct(x.cast("int").alias("s"), (x + span).cast("int").alias("e")))
    return hits.groupBy("row").agg(spans.alias("hit"), F.array_remove(F.array_sort(F.collect_set("item")), _NO_ID).alias("items"))


HITS = "{} long, {} array<struct<s:int,e:int>>, {} array<long>"


def find_hits(docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", carry: tuple[str, ...] = (), span: int = 10, k: int = 5, block_bytes: int = 128 << 20, most_blocks: int = 4, prefix: str = "") -> DataFrame:
    """id, carried columns, n_words, hit (joined spans of hit words), items (ids, distinct).

    prefix goes before the new columns' names, for carried columns that clash.
    """
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    # A carried text travels to Python once.
    # Names that mapInArrow takes: it resolves a.b as a field.
    safe = {c: own_name(docs, f"__c{i}") for i, c in enumerate(carry)}
    held = safe[text_col] if text_col in carry else own_name(docs, "__text")
    extra = [] if text_col in carry else [F.col(text_col).cast("string").cast("binary").alias(held)]
    key, row_no = own_name(docs, "__id"), own_name(docs, "__row")
    base = docs.select(F.col(id_col).alias(key), *extra, *[col(c).alias(safe[c]) for c in carry])
    away = set() if text_col in carry else {held}
    kept = [f for f in base.schema.fields if f.name not in away]
    made = n_col, hit_col, items_col = tuple(own_name(docs, "__" + c) for c in ("n_words", "hit", "items"))
    hit_fields = StructType.fromDDL(HITS.format(*made))

    def pass_over(index: Index, frame: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                n_words, hit, items = [], [], []
                for _, texts in _slices(b.column(b.schema.get_field_index(held)).cast(pa.binary())):
                    for n, found in _scan(own, texts):
                        spans: list[dict] = []
                        for s, size, _i in sorted(found, key=lambda x: x[0]):
                            if spans and s <= spans[-1]["e"]:
                                spans[-1]["e"] = max(spans[-1]["e"], s + size)
                            else:
                                spans.append({"s": s, "e": s + size})
                        n_words.append(n)
                        hit.append(spans)
                        items.append(sorted({i for _, _, g in found for i in g if i is not None}))
                names = [f.name for f in b.schema if f.name not in away]
                arrays = [b.column(b.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays(
                    arrays + [pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(items, pa.list_(pa.int64()))],
                    [*names, *made],
                )

        return frame.mapInArrow(run, StructType([f for f in frame.schema.fields if f.name not in away] + hit_fields.fields))

    # A word is seven bytes or so with its blank.
    n_bytes = bench.agg(F.sum(F.octet_length(F.col(item_text_col).cast("string")))).first()[0] or 0
    wide, joined = bench, None
    if n_bytes + n_bytes // 7 * WORD_BYTES > most_blocks * block_bytes:
        held_items = bench.select(F.col(item_col).cast("long").alias(item_col), F.col(item_text_col).cast("string").cast("binary").alias(item_text_col)).filter(F.col(item_text_col).isNotNull())
        held_items = materialize(held_items.mapInArrow(lambda batches: _counted(batches), f"`{item_col}` long, `{item_text_col}` binary, n_words long"), "decontaminate-items")
        wide = held_items.filter(F.col("n_words") < span)
        joined = held_items.filter(F.col("n_words") >= span).select(F.coalesce(item_col, F.lit(_NO_ID)).alias("item"), F.col(item_text_col).alias("text"))
    indexes = blocks_of(wide, item_col, item_text_col, block_bytes, span, k)
    first = next(indexes, None) or Index([], span, k)
    second = next(indexes, None)
    if second is None and joined is None:
        out = pass_over(first, base)
    else:
        # More than one part: each leaves its hits by row, united at the end.
        keyed = materialize(base.withColumn(row_no, F.monotonically_increasing_id()), "decontaminate-rows")
        parts = [materialize(pass_over(first, keyed), "decontaminate-block")]
        while second is not None:
            parts.append(materialize(pass_over(second, keyed).select(row_no, hit_col, items_col).filter(F.size(hit_col) > 0), "decontaminate-block"))
            second = next(indexes, None)
        if joined is not None:
            texts = keyed.select(F.col(row_no).alias("row"), F.col(held).cast("string").cast("binary").alias("text"))
            got = join_hits(texts, joined, span, k)
            parts.append(materialize(got.select(F.col("row").alias(row_no), F.col("hit").alias(hit_col), F.col("items").alias(items_col)), "decontaminate-joined"))
        more = parts[1]
        for p in parts[2:]:
            more = more.unionByName(p)
        h2, i2 = own_name(keyed, "__h2"), own_name(keyed, "__i2")
        more = more.groupBy(row_no).agg(F.flatten(F.collect_list(hit_col)).alias(h2), F.flatten(F.collect_list(items_col)).alias(i2))
        both = parts[0].join(more, row_no, "left")
        none_h, none_i = (F.from_json(F.lit("[]"), t) for t in ("array<struct<s:int,e:int>>", "array<bigint>"))
        spans = F.array_sort(F.concat(hit_col, F.coalesce(h2, none_h)))
        merged = F.aggregate(
            spans, none_h,
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (x["s"] <= F.element_at(acc, -1)["e"]),
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))),
            ).otherwise(F.concat(acc, F.array(x))),
        )
        out = both.select(*[f.name for f in kept], n_col, merged.alias(hit_col), F.array_sort(F.array_distinct(F.concat(items_col, F.coalesce(i2, none_i)))).alias(items_col))
    new = [F.col(c).alias(prefix + n) for c, n in zip(made, ("n_words", "hit", "items"))]
    return out.select(F.col(key).alias(id_col), *[F.col(safe[c]).alias(c) for c in carry if c != id_col], *new)


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
