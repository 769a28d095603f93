"""Near-duplicate documents of a stated Jaccard similarity of word shingles.

Two texts are alike if their sets of k-word shingles (A-Z lower-cased) have a
Jaccard similarity of at least ``least``.  Links are found in five steps:

0. Anchors.  Texts whose SimHash fingerprints differ in at most four bits meet at
   an anchor (simhash.link, op6's operator); each pair it connects is decided like
   any other by step 4.  Pairs further apart, as most at 0.8 are, take steps 1 to 3.
1. Prints.  PERMUTATIONS MinHash values of a text give BANDS band keys of
   VALUES values each, and a sketch of two bits a value.  Texts are candidates
   if they share a band key.  At 0.8 a pair shares none with a chance of
   (1 - 0.8 ** 6) ** 40 = 5e-6, however its texts differ.
2. Stars.  In each band group one member is the pivot: the one that meets the
   most other texts over all bands, which in a family of copies is its source.
   Every member is asked against the pivot.
3. Cross pairs.  In a group whose members now lie in several components, all
   pairs across components are compared by their sketches, in cells of bounded
   size (below).  A pair within a component can't change the result.
4. A pair whose sketches estimate a similarity of less than ``least`` by 4.5
   standard errors is dropped (chance 3e-6 for a pair at ``least``); all others
   are decided by their shingles, each a 64-bit hash of its words' hashes.

Skew.  A group of m members of which s lie outside its largest component needs
m x s comparisons of sketches.  They are dealt as cells of about 2 x CELL rows and
2 x CELL_BYTES of shingles, so no task holds a group.  Pairs never leave a cell:
from the sketches it passes on its members that have a possible partner, once
each; these come back with their shingles, and the cell passes on links, no more
than connect its members.  Members whose shared shingles (those that another member
of the cell has) are too few, such as pages of one template, are out before any
two sets meet.  Exact copies are one node throughout.

Defined cases: texts without words are alike; a text of fewer than k words is
one shingle; a null text is an empty one; rows of one id with several texts are
several nodes; a null id counts as the largest; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cols, drop_table, materialize, own_name
from .components import connected_components
from .decontaminate import gram_hashes
from .simhash import fingerprint, link

PERMUTATIONS, BANDS, VALUES = 512, 40, 6
CELL, CELL_BYTES = 2048, 16 << 20
_FACTORS = np.random.default_rng(20).integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
_PAIR_BITS = np.uint64(0x5555555555555555)
#: bytes of a sketch, and of the band keys' low halves behind it
SKETCH, TAIL = PERMUTATIONS // 4, 4 * BANDS


def shingle_codes(text: bytes | None, k: int) -> np.ndarray:
    """64-bit hash of each k words in a row, made of the words' hashes; of all words, if fewer."""
    import xxhash

    words = text.translate(LOWER).split() if text else []
    if len(words) <= k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
    return gram_hashes(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), k)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets (sorted arrays without repeats) have a Jaccard similarity of at least `least`; two empty ones are alike."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both)


def shingle_hashes(text: bytes | None, k: int = 5) -> np.ndarray:
    """The text's set of shingles as sorted hashes."""
    return np.unique(shingle_codes(text, k))


def prints(text: bytes | None, k: int = 5) -> tuple[list[int], bytes, int]:
    """(band keys, sketch and low halves of the band keys, number of different shingles); texts without words have equal prints."""
    import xxhash

    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    own = shingle_hashes(text, k)
    hashes = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(hashes), 512):
        np.minimum(least, np.multiply.outer(_FACTORS, hashes[at : at + 512]).min(axis=1), out=least)
    bands = least[: BANDS * VALUES].astype("<u4").reshape(BANDS, VALUES)
    keys = np.array([xxhash.xxh3_64_intdigest(r.tobytes(), i) for i, r in enumerate(bands)], np.uint64)
    two = (least * np.uint32(0x9E3779B1)) >> np.uint32(30)
    packed = (two.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint32)).sum(axis=1).astype(np.uint8)
    return keys.view(np.int64).tolist(), packed.tobytes() + keys.astype("<u4").tobytes(), len(own)


def most_apart(least: float) -> int:
    """Differing values of two sketches up to which a pair at `least` stays, but for 4.5 standard errors."""
    p = (1 - least) * 0.75
    return int(PERMUTATIONS * p + 4.5 * (PERMUTATIONS * p * (1 - p)) ** 0.5)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing two-bit values of sketches held as words."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & _PAIR_BITS).sum(axis=-1, dtype=np.int64)


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sketches as words, low halves of the band keys) of a column of prints."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH + TAIL)
    return np.ascontiguousarray(data[:, :SKETCH]).view("<u8"), np.ascontiguousarray(data[:, SKETCH:]).view("<u4")


class Members:
    """Members of one cell: those at home, and strays (outside the group's largest component)."""

    def __init__(self, t: pa.Table, most: int):
        num = lambda c: t.column(c).to_numpy()
        self.node, self.root, home, self.size = num("node"), num("root"), num("home"), num("size")
        self.sketch, self.low = _unpack(t.column("print").combine_chunks())
        self.band, self.top, self.most = int(num("band")[0]), int(num("top")[0]), most
        self.at_home, self.strays = np.flatnonzero(home), np.flatnonzero(~home)

    def pairs(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (member at home, stray) with different roots, alike in size and sketch, that share no earlier band."""
        h = self.at_home
        for at in range(0, len(self.strays), 64):
            part = self.strays[at : at + 64]
            small, large = (f(self.size[h][:, None], self.size[part][None]) for f in (np.minimum, np.maximum))
            ok = (self.root[h][:, None] != self.root[part][None]) & (small >= least * large)
            a, b = np.nonzero(ok & (apart(self.sketch[h][:, None], self.sketch[part][None]) <= self.most))
            x, y = h[a], part[b]
            # two strays meet in both their homes
            now = (self.root[x] == self.top) | (self.node[x] < self.node[y])
            x, y = x[now], y[now]
            first = (self.low[x] == self.low[y]).argmax(axis=1) == self.band
            yield x[first], y[first]

    def involved(self, least: float) -> np.ndarray:
        """Which members are in some pair."""
        mark = np.zeros(len(self.node), bool)
        for x, y in self.pairs(least):
            mark[x] = mark[y] = True
        return mark

    def links(self, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
        """Pairs (u, v) of nodes alike by their shingles, enough to connect all that are."""
        place = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        held, where = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        # a node may be here at home and as a stray: shingles count once a node
        _, node = np.unique(self.node, return_inverse=True)
        once = np.unique(np.stack([where.ravel(), node[place]]), axis=1)
        common = np.bincount(once[0], minlength=len(held)) > 1
        shared = np.bincount(place[common[where.ravel()]], minlength=len(sets))
        above = {int(r): int(r) for r in self.root}

        def find(r: int) -> int:
            while above[r] != r:
                above[r] = r = above[above[r]]
            return r

        out = []
        for x, y in self.pairs(least):
            both = self.size[x] + self.size[y]
            may = np.minimum(shared[x], shared[y]) * (1 + least) >= least * both - 1e-6
            may |= both == 0
            for i, j in zip(x[may].tolist(), y[may].tolist()):
                r, q = find(int(self.root[i])), find(int(self.root[j]))
                if r != q and similar(sets[i], sets[j], least):
                    above[r] = q
                    out.append((int(self.node[i]), int(self.node[j])))
        return out


CELL_KEY = ("key", "c", "d")


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell; batches are sorted by cell."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in CELL_KEY])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            here = tuple(keys[:, s])
            if here != at and held:
                yield pa.Table.from_batches(held)
                held = []
            at = here
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def anchor_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes, enough to connect all whose fingerprints (fp) link by op6's anchors."""
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "similar-prints")
    end = lambda c, n: first.select(F.col("fp").alias(c), F.col("first").alias(n))
    met = link(first).join(end("u", "a"), "u").join(end("v", "b"), "v").select(*_pair("a", "b"))
    return met.unionByName(nodes.select("fp", "node").join(first, "fp").filter("node != first").select(*_pair("node", "first")))


def band_groups(nodes: DataFrame) -> DataFrame:
    """Groups of nodes that share a band key: key, band, node, n (members)."""
    spread = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return spread.join(sizes, "key").select("key", "band", "node", "n")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8, cell: int = CELL) -> DataFrame:
    """One row for each distinct (id, text): id, digest (of the text), n (rows), component, is_first.

    component is the smallest id of the texts reachable over links (null if none
    has one).  is_first marks one row a component: that with the smallest id,
    and of its texts the one with the smallest digest.
    """
    most = most_apart(least)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            texts = b.column(2)
            got = [prints(texts[i].as_py(), k) for i in range(b.num_rows)]
            fps = np.fromiter((fingerprint(texts[i].as_py()) for i in range(b.num_rows)), np.uint64, b.num_rows)
            cols = [pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.int64()), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["id", "digest", "keys", "print", "size", "fp"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(texts[i].as_py(), k).tobytes() for i in range(b.num_rows)], pa.large_binary())], ["node", "hashes"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok = pa.array(apart(_unpack(b.column(2))[0], _unpack(b.column(3))[0]) <= most)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            ok = pa.array([similar(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64), least) for i in range(b.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_cell(batches):
            yield from t.filter(pa.array(Members(t, most).involved(least))).select(member).combine_chunks().to_batches()

    def cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_cell(batches):
            got = Members(t, most).links([np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()], least)
            u, v = (pa.array([f(p) for p in got], pa.int64()) for f in (min, max))
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"])

    tables: list[DataFrame] = []

    def written(df: DataFrame, name: str) -> DataFrame:
        tables.append(materialize(df, name))
        return tables[-1]

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.cast("binary").alias("text"))
    rows = written(base.mapInArrow(keys, "id long, digest binary, keys array<long>, print binary, size long, fp long"), "similar-rows")
    distinct = rows.groupBy("digest").agg(F.first("keys").alias("keys"), F.first("print").alias("print"), F.first("size").alias("size"), F.first("fp").alias("fp"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "similar-nodes")

    anchored = written(anchor_pairs(nodes), "similar-anchored")

    # Groups of texts that share a band key, and the member each is asked against.
    members = written(band_groups(nodes), "similar-members")
    weight = written(members.groupBy("node").agg(F.sum("n").alias("w")), "similar-weights")
    pivots = written(members.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", "node"))["node"].alias("pivot")), "similar-pivots")
    grouped = members.join(pivots, "key").filter("node != pivot")

    # The shingles of texts in some group or pair; the others never travel again.
    one_text = base.groupBy("digest").agg(F.first("text").alias("text"))
    met = weight.select("node").unionByName(anchored.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    wanted = nodes.select("node", "digest").join(met, "node")
    sets = written(one_text.join(wanted, "digest").select("node", "text").mapInArrow(hashed, "node long, hashes binary"), "similar-sets")

    def both(pairs: DataFrame, side: DataFrame, col: str) -> DataFrame:
        a, b = (side.select(F.col("node").alias(n), F.col(col).alias(as_)) for n, as_ in (("u", "x"), ("v", "y")))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y")

    def alike(pairs: DataFrame) -> DataFrame:
        return written(both(pairs, sets, "hashes").mapInArrow(verify, "u long, v long"), "similar-alike")

    asked = written(grouped.select(*_pair("node", "pivot")).unionByName(anchored).distinct(), "similar-stars")
    links = alike(both(asked, nodes, "print").mapInArrow(near, "u long, v long"))
    roots = connected_components(links, "similar-links")

    # The pivot has met all its group; a group of two is done.
    left = written(grouped.filter("n > 2").select("key", "band", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "similar-left")
    sized = left.join(nodes.select("node", F.col("size").alias("s")), "node")
    per_root = sized.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
    split = per_root.groupBy("key").agg(F.max(F.struct("n", "root", "s")).alias("top"), F.sum("n").alias("m"), F.sum("s").alias("s"), F.count("*").alias("parts")).filter("parts > 1")
    many = lambda n, s: F.greatest(F.ceil(n / cell), F.ceil(8 * s / CELL_BYTES), F.lit(1)).cast("int")
    shape = split.select("key", F.col("top.root").alias("top"), many(F.col("m"), F.col("s")).alias("across"), many(F.col("m") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("down"))
    held = left.join(written(shape, "similar-shape"), "key").join(nodes.select("node", "print", "size"), "node")
    c, d = F.pmod(F.xxhash64("node"), "across").cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), "down").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    member = ["key", "band", "node", "root", "top", "home", "c", "d"]
    cols = ["key", "band", "node", "root", "top", "print", "size"]
    at_home = held.select(*cols, F.lit(True).alias("home"), c.alias("c"), every("down").alias("d"))
    strays = held.filter("root != top").select(*cols, F.lit(False).alias("home"), every("across").alias("c"), d.alias("d"))
    dealt = at_home.unionByName(strays).repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY)
    involved = written(dealt.select(*member, "print", "size").mapInArrow(cells, "key long, band int, node long, root long, top long, home boolean, c int, d int"), "similar-involved")
    back = involved.join(nodes.select("node", "print", "size"), "node").join(sets, "node").repartition(*CELL_KEY).sortWithinPartitions(*CELL_KEY)
    across = written(back.mapInArrow(cell_links, "u long, v long"), "similar-cross")
    roots = connected_components(links.unionByName(across), "similar-links")

    named = written(nodes.select("node", "digest").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "similar-roots")
    per = written(rows.groupBy("id", "digest").agg(F.count("*").alias("n")).join(named, "digest"), "similar-ids")
    first = written(per.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")), "similar-firsts")
    for t in tables:
        if t is not per and t is not first:
            drop_table(t)
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    return per.join(first, "root").select(F.col("id").alias(id_col), "digest", "n", F.col("first.id").alias("component"), own.alias("is_first"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each component of texts alike: that similar_groups marks as first.

    Rows that repeat this one's id and text go too; the row with the smallest
    values in the other columns stays.  A row is judged by its own text, so of
    one id's rows some may go and others stay.
    """
    digest, mark, own, its = (own_name(docs, n) for n in ("__digest", "__mark", "__own", "__its"))
    groups = similar_groups(docs, id_col, text_col, **options).select(F.col(id_col).alias(own), F.col("digest").alias(its), "n", "is_first")
    groups = materialize(groups, "similar-groups")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(digest, F.unhex(F.sha2(text, 256)))
    same = lambda g: keyed[id_col].cast("long").eqNullSafe(g[own]) & (keyed[digest] == g[its])
    gone = groups.filter("not is_first").select(own, its)
    again = groups.filter("is_first and n > 1").select(own, its, F.lit(True).alias(mark))
    if again.isEmpty():
        return keyed.join(gone, same(gone), "left_anti").select(*cols(docs))
    # Only rows that repeat are gathered by id and text.
    marks = again.unionByName(gone.withColumn(mark, F.lit(False)))
    told = materialize(keyed.join(marks, same(marks), "left").filter(F.coalesce(mark, F.lit(True))).select(*cols(docs), digest, mark), "similar-kept")
    row = F.struct(*cols(docs))
    once = told.filter(F.col(mark)).groupBy(F.col(id_col).alias(own), digest).agg(F.min(row).alias("r")).select("r.*")
    return told.filter(F.col(mark).isNull()).select(*cols(docs)).unionByName(once)
