"""Queries over blocks, hierarchy and evidence of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import blocks as B
from ..operators import evidence as E
from ..operators import hierarchy as H
from ..operators import places as P
from ..operators import raster as G
from ..operators.folds import recursive_split_udf
from . import inputs as I
from .registry import query

S = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
DOC = "doc_id"
L = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


@query(f"""WITH {I.BLOCKS},
k AS (SELECT doc_id, {S} AS t, height FROM blocks WHERE length({S}) > 0 GROUP BY ALL HAVING count(*) > 1)
SELECT b.doc_id, b.pos, b.page, b.text, b.height FROM blocks b
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = b.doc_id AND k.t = regexp_replace(b.text, '^\\s+|\\s+$', '', 'g') AND k.height = b.height)
  AND (length(regexp_replace(b.text, '^\\s+|\\s+$', '', 'g')) > 0 OR b.doc_id NOT IN (SELECT doc_id FROM k))""")
def repeated_block_filter(spark, d):
    return B.drop_repeated(I.blocks(spark, d)).select(DOC, *L("pos", "page"), "text", "height")


@query(f"WITH {I.BLOCKS} SELECT doc_id, {S} AS key_text, height AS key_height, count(*) AS n FROM blocks WHERE length({S}) > 0 GROUP BY ALL HAVING count(*) > 1")
def repeated_block_keys(spark, d):
    return B.repeated_keys(I.blocks(spark, d))


@query(f"WITH {I.BLOCKS} SELECT doc_id, pos, text FROM blocks WHERE length({S}) > 0")
def drop_blank_blocks(spark, d):
    return B.drop_blank(I.blocks(spark, d)).select(DOC, *L("pos"), "text")


#: Digits beside the decimal ones, as ranges: superscripts, subscripts, circled, in brackets, with a stop, and of a few scripts.
_OTHER_DIGITS = r"\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"


@query(rf"""WITH w AS (SELECT doc_id, unnest(string_split(replace(text, '10', '²³'), ' ')) AS word FROM documents)
SELECT doc_id, count(*) AS n_kept, sum(length(word))::BIGINT AS n_chars_kept FROM w WHERE NOT regexp_matches(word, '^[\p{{Nd}}{_OTHER_DIGITS}]+$') GROUP BY doc_id""")
def filter_numeric_blocks(spark, d):
    """Words of documents in which 10 is written as two superscript digits."""
    w = I.table(spark, d, "documents").select(DOC, F.explode(F.split(F.replace("text", F.lit("10"), F.lit("²³")), " ", -1)).alias("text"))
    return B.drop_numeric(w).groupBy(DOC).agg(F.count("*").alias("n_kept"), F.sum(F.length("text")).alias("n_chars_kept"))


@query(f"""WITH {I.BLOCKS} SELECT doc_id, pos, coalesce(nullif(CASE WHEN pos % 3 = 0 THEN '' ELSE text END, ''), text) AS block_text,
  array_to_string(regexp_extract_all(coalesce(nullif(CASE WHEN pos % 3 = 0 THEN '' ELSE text END, ''), text), '\\S+'), ' ') AS norm_text, page AS block_page FROM blocks WHERE pos % 5 <> 4""")
def normalize_blocks(spark, d):
    b = I.blocks(spark, d)
    raw = b.select(DOC, "pos", F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("text")).alias("text"), F.col("text").alias("content"), F.when(F.col("pos") % 2 == 0, F.when(F.col("pos") % 5 != 4, F.col("page"))).alias("page"), F.when(F.col("pos") % 5 != 4, F.col("page")).alias("page_num"))
    return B.resolve_aliases(raw).select(DOC, *L("pos"), "block_text", "norm_text", *L("block_page"))


@query(f"WITH {I.ELEMENTS} SELECT doc_id, page, median(height) AS median_height FROM elements GROUP BY ALL")
def median_height(spark, d):
    return I.elements(spark, d).groupBy(DOC, F.col("page").cast("long").alias("page")).agg(F.median("height").alias("median_height"))


ASSIGN = I.WORDS + ", " + I.REGIONS + r""",
hit AS (SELECT w.doc_id, w.page, w.word_no, min(r.region_ord) AS region_ord FROM words w JOIN regions r ON w.doc_id = r.doc_id AND w.page = r.page
  AND w.x0 < r.x1 + 0.3 AND w.x1 > r.x0 - 0.3 AND w.y0 < r.y1 + 0.3 AND w.y1 > r.y0 - 0.3 GROUP BY ALL),
assigned AS (SELECT w.*, h.region_ord FROM words w LEFT JOIN hit h USING (doc_id, page, word_no))"""


def _assigned(spark, d):
    return B.assign_words(I.words(spark, d), I.regions(spark, d), [DOC, "page"], "word_no", "region_ord")


@query(f"WITH {ASSIGN} SELECT doc_id, page, word_no, region_ord FROM assigned WHERE region_ord IS NOT NULL")
def word_region_assign(spark, d):
    return _assigned(spark, d).filter("region_ord is not null").select(DOC, *L("page", "word_no", "region_ord"))


@query(f"WITH {ASSIGN} SELECT doc_id, count(*) AS n_unassigned FROM assigned WHERE region_ord IS NULL GROUP BY doc_id")
def unassigned_words(spark, d):
    return _assigned(spark, d).filter("region_ord is null").groupBy(DOC).agg(F.count("*").alias("n_unassigned"))


@query(f"WITH {ASSIGN} SELECT doc_id, page, region_ord, median(y1 - y0) AS height_median, min(y1 - y0) AS height_min FROM assigned WHERE region_ord IS NOT NULL GROUP BY ALL")
def region_height_stats(spark, d):
    return B.assemble_text(_assigned(spark, d).filter("region_ord is not null"), [DOC, "page", "region_ord"]).select(DOC, *L("page", "region_ord"), "height_median", "height_min")


@query(f"""WITH {ASSIGN}, s AS (SELECT *, row_number() OVER w AS n, CASE WHEN row_number() OVER w = 1 THEN '' WHEN abs(lag(y0) OVER w - y0) < CASE WHEN y1 - y0 > 0 THEN 0.6 * (y1 - y0) ELSE 2 END THEN ' ' ELSE chr(10) END AS sep
  FROM assigned WHERE region_ord IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page, region_ord ORDER BY y0, x0, word_no))
SELECT doc_id, page, region_ord, string_agg(sep || text, '' ORDER BY n) AS block_text FROM s GROUP BY ALL""")
def block_text_assemble(spark, d):
    return B.assemble_text(_assigned(spark, d).filter("region_ord is not null"), [DOC, "page", "region_ord"]).select(DOC, *L("page", "region_ord"), "block_text")


_FEATURE_SQL = """count(*)::DOUBLE AS n_boxes, round(median(x1 - x0), 6) AS width_median, round(stddev_pop(x1 - x0), 6) AS width_std, round(median(y1 - y0), 6) AS height_median, round(stddev_pop(y1 - y0), 6) AS height_std,
round(median((x0 + x1) / 2), 6) AS x_centre_median, round(stddev_pop((x0 + x1) / 2), 6) AS x_centre_std, round(median((y0 + y1) / 2), 6) AS y_centre_median, round(stddev_pop((y0 + y1) / 2), 6) AS y_centre_std,
round(sum(x1 - x0) / 600, 6) AS width_share, round(median(CASE WHEN y1 = y0 THEN 0 ELSE (x1 - x0) / (y1 - y0) END), 6) AS aspect_median, round(median(x1 - x0) / 600, 6) AS width_norm_median, round(median((x0 + x1) / 2) / 600, 6) AS x_centre_norm_median"""


@query(f"WITH {I.WORDS} SELECT doc_id, page, {_FEATURE_SQL} FROM words GROUP BY ALL")
def layout_features(spark, d):
    f = B.layout_features(I.words(spark, d), [DOC, "page"], 600.0)
    return f.select(DOC, *L("page"), *[F.round(c, 6).alias(c) for c in B.FEATURES])


@query(f"WITH {I.WORDS}, f AS (SELECT doc_id, page, {_FEATURE_SQL} FROM words GROUP BY ALL) SELECT doc_id, round(avg(n_boxes), 6) AS n_boxes, round(avg(width_median), 6) AS width_median FROM f WHERE page < 5 GROUP BY doc_id")
def layout_features_document(spark, d):
    f = B.layout_features(I.words(spark, d).filter("page < 5"), [DOC, "page"], 600.0).withColumn("width_median", F.round("width_median", 6))
    return B.document_features(f, columns=("n_boxes", "width_median")).select(DOC, F.round("n_boxes", 6).alias("n_boxes"), F.round("width_median", 6).alias("width_median"))


@query(f"""WITH {I.WORDS}, r AS (SELECT *, CASE WHEN x0 < 50 + 2.5 AND x1 > 50 - 2.5 AND x1 - x0 > 60 THEN 0 WHEN (x0 + x1) / 2 < 50 THEN 1 ELSE 2 END AS bucket FROM words)
SELECT doc_id, page, word_no, bucket::BIGINT AS bucket, row_number() OVER (PARTITION BY doc_id, page ORDER BY bucket, y0, x0, word_no) AS reading_order FROM r""")
def multicolumn_order(spark, d):
    w = I.words(spark, d).withColumn("bucket", B.multicolumn_rank(F.col("x0"), F.col("x1"), F.lit(100.0)))
    return B.reading_order(w, [DOC, "page"], "word_no", bucket="bucket").select(DOC, *L("page", "word_no", "bucket", "reading_order"))


@query(f"WITH {I.WORDS} SELECT doc_id, word_no, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, word_no) AS n FROM words")
def reading_order(spark, d):
    return B.reading_order(I.words(spark, d), [DOC], "word_no", page="page", name="n").select(DOC, "word_no", "n")


_PAIR = I.ELEMENTS + ", " + I.REGIONS + r""", p AS (SELECT doc_id, page, region_ord, x0 AS ax0, y0 AS ay0, x1 AS ax1, y1 AS ay1, lead(x0) OVER w AS bx0, lead(y0) OVER w AS by0, lead(x1) OVER w AS bx1, lead(y1) OVER w AS by1 FROM regions WINDOW w AS (PARTITION BY doc_id, page ORDER BY region_ord)),
g AS (SELECT *, greatest(ax0, bx0) - least(ax1, bx1) AS hg, greatest(ay0, by0) - least(ay1, by1) AS vg FROM p WHERE bx0 IS NOT NULL)"""


def _pairs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy(DOC, "page").orderBy("region_ord")
    r = I.regions(spark, d).withColumn("a", F.struct("x0", "y0", "x1", "y1"))
    return r.withColumn("b", F.lead("a").over(w)).filter("b is not null")


@query(f"""WITH {_PAIR} SELECT doc_id, page, region_ord, (hg < 0 AND vg < 0) OR (abs((ay0 + ay1) / 2 - (by0 + by1) / 2) < (ay1 - ay0 + by1 - by0) / 2 AND hg >= 0 AND hg < 8)
  OR (vg >= 0 AND vg < 1 AND (greatest(0, -hg) >= 0.75 * least(ax1 - ax0, bx1 - bx0) OR (ax0 >= bx0 AND ax1 <= bx1) OR (bx0 >= ax0 AND bx1 <= ax1))) AS merges FROM g""")
def rect_should_merge(spark, d):
    return _pairs(spark, d).select(DOC, *L("page", "region_ord"), geometry.should_merge(F.col("a"), F.col("b")).alias("merges"))


@query(f"WITH {_PAIR} SELECT doc_id, page, region_ord, least(ax0, bx0) AS x0, least(ay0, by0) AS y0, greatest(ax1, bx1) AS x1, greatest(ay1, by1) AS y1, (ax1 - ax0) * (ay1 - ay0) AS area, round((ax1 - ax0) / (ay1 - ay0), 6) AS aspect FROM g")
def rect_union(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).withColumn("u", geometry.union(a, b)).select(DOC, *L("page", "region_ord"), "u.*", geometry.area(a).alias("area"), F.round(geometry.aspect(a), 6).alias("aspect"))


@query(f"WITH {_PAIR} SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM regions GROUP BY ALL")
def union_box(spark, d):
    return B.bounding_boxes(I.regions(spark, d), [DOC, F.col("page").cast("long").alias("page")])


@query(f"WITH {I.ELEMENTS}, {I.REGIONS} SELECT doc_id, page, region_ord FROM regions WHERE x1 - x0 >= 70 AND y1 - y0 >= 8")
def region_size_filter(spark, d):
    return B.large_regions(I.regions(spark, d), 70, 8).select(DOC, *L("page", "region_ord"))


@query(f"WITH {I.ELEMENTS}, {I.REGIONS} SELECT doc_id, page, region_ord FROM regions WHERE x1 - x0 >= 75 AND y1 - y0 >= 4")
def region_half_size_filter(spark, d):
    return B.large_regions(I.regions(spark, d), 150, 8, half=True).select(DOC, *L("page", "region_ord"))


@query(f"""WITH RECURSIVE {I.WORDS}, seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY word_no) AS n FROM words),
walk AS (SELECT doc_id, page, n, x0, y0, x1, y1, y1 - y0 AS height, text, 0 AS block_no FROM seq WHERE n = 1
  UNION ALL SELECT s.doc_id, s.page, s.n, CASE WHEN {{j}} THEN w.x0 ELSE s.x0 END, CASE WHEN {{j}} THEN w.y0 ELSE s.y0 END, CASE WHEN {{j}} THEN greatest(w.x1, s.x1) ELSE s.x1 END, CASE WHEN {{j}} THEN greatest(w.y1, s.y1) ELSE s.y1 END, s.y1 - s.y0, s.text, w.block_no + CASE WHEN {{j}} THEN 0 ELSE 1 END
  FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.page = w.page AND s.n = w.n + 1)
SELECT doc_id, page, block_no, arg_max(x0, n) AS x0, arg_max(y0, n) AS y0, arg_max(x1, n) AS x1, arg_max(y1, n) AS y1, string_agg(text, ' ' ORDER BY n) AS text, arg_max(height, n) AS height FROM walk GROUP BY ALL""".replace("{j}", "(s.y1 - s.y0 = w.height AND abs(s.x0 - w.x1) <= 0.0092625 * 600 AND s.y0 - w.y1 <= 0.05 * 800)"))
def word_block_merge(spark, d):
    b = B.merge_word_blocks(I.words(spark, d), [DOC, "page"], ["word_no"], 600.0, 800.0)
    return b.select(DOC, *L("page", "block_no"), "x0", "y0", "x1", "y1", "text", "height")


@query(f"""WITH {I.ELEMENTS}, {I.REGIONS}, i AS (SELECT *, region_ord - row_number() OVER (PARTITION BY doc_id, page ORDER BY region_ord) AS island FROM regions),
m AS (SELECT doc_id, page, island, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY ALL)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY island) - 1 AS region_no, x0, y0, x1, y1 FROM m""")
def merge_regions(spark, d):
    """Here a line's region overlaps the next line's and no other, so what merges are runs of lines."""
    return B.merge_regions(I.regions(spark, d), [DOC, "page"], ["region_ord"]).select(DOC, *L("page", "region_no"), "x0", "y0", "x1", "y1")


@query()
def merge_pixel_boxes(spark, d):
    return B.merge_regions(I.regions(spark, d), [DOC, "page"], ["region_ord"], pixels=True)


NGE = I.ELEMENTS + r""", ranked AS (SELECT doc_id, pos, page, text, height, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM elements),
nge AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND b.i > a.i AND b.height >= a.height GROUP BY ALL),
pg AS (SELECT a.doc_id, a.i, max(b.i) AS p FROM ranked a JOIN ranked b ON a.doc_id = b.doc_id AND b.i < a.i AND b.height > a.height GROUP BY ALL),
spans AS (SELECT r.*, coalesce(nge.j, r.n) - r.i - 1 AS span, q.pos AS parent FROM ranked r LEFT JOIN nge USING (doc_id, i) LEFT JOIN pg USING (doc_id, i) LEFT JOIN ranked q ON q.doc_id = r.doc_id AND q.i = pg.p)"""
NODES = NGE + r""", c AS (SELECT *, sum(CASE WHEN span > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS parents FROM spans),
nodes AS (SELECT * FROM (SELECT doc_id, pos AS node, CASE WHEN parents = 0 THEN 0 WHEN span > 0 THEN 1 WHEN parent IS NOT NULL THEN 2 END AS depth, CASE WHEN parents > 0 AND span = 0 AND parent IS NOT NULL THEN parent ELSE -1 END AS parent,
  '[Page:' || page || '] ' || regexp_replace(text, '^\s+|\s+$', '', 'g') AS name FROM c) WHERE depth IS NOT NULL)"""


@query(f"WITH {NGE} SELECT doc_id, pos, span FROM spans")
def child_spans(spark, d):
    return H.spans(I.elements(spark, d)).select(DOC, *L("pos", "span"))


@query(f"WITH {NGE} SELECT doc_id, pos, parent FROM spans")
def parent_assign(spark, d):
    return H.spans(I.elements(spark, d)).select(DOC, *L("pos", "parent"))


def _nodes(spark, d):
    return H.tree(I.elements(spark, d))


@query(f"WITH {NODES} SELECT doc_id, node, parent, depth::BIGINT AS depth, name FROM nodes")
def document_tree(spark, d):
    return _nodes(spark, d)


@query(f"WITH {NODES} SELECT doc_id, depth::BIGINT AS depth, count(*) AS n_nodes FROM nodes WHERE depth > 0 GROUP BY ALL UNION ALL SELECT doc_id, 0, 1 FROM nodes GROUP BY doc_id")
def depth_histogram(spark, d):
    return H.depth_histogram(_nodes(spark, d))


LEVEL = NODES + r""", lv AS (SELECT doc_id, count(*) FILTER (WHERE depth = 1) AS n_parents, count(*) FILTER (WHERE depth = 2) AS n_leaves FROM nodes WHERE depth > 0 GROUP BY doc_id),
levels AS (SELECT *, CASE WHEN n_parents >= n_leaves THEN 0 ELSE 1 END AS level FROM lv)"""


@query(f"WITH {LEVEL} SELECT doc_id, n_parents, n_leaves, level::BIGINT AS level FROM levels")
def content_level(spark, d):
    return H.content_level(_nodes(spark, d))


def _merged(fixed: bool) -> str:
    drop = r"^\[Page:\s*(\d+)\s*\]\s*" + ("" if fixed else "(.*)")
    return rf""", parts AS (SELECT p.doc_id, p.node, p.name AS pname, l.node AS leaf, CASE WHEN regexp_extract(l.name, '^\[Page:\s*(\d+)', 1) = regexp_extract(p.name, '^\[Page:\s*(\d+)', 1) THEN regexp_replace(regexp_replace(l.name, '{drop}', ''), '^\s+|\s+$', '', 'g') ELSE l.name END AS part
  FROM nodes p JOIN levels v ON v.doc_id = p.doc_id AND v.level = 1 LEFT JOIN nodes l ON l.doc_id = p.doc_id AND l.depth = 2 AND l.parent = p.node WHERE p.depth = 1),
merged AS (SELECT doc_id, node, pname || coalesce(string_agg(' ' || part, '' ORDER BY leaf) FILTER (WHERE length(part) > 0), '') AS text FROM parts GROUP BY doc_id, node, pname)"""


@query(f"WITH {LEVEL}{_merged(False)} SELECT doc_id, node, text FROM merged")
def merge_leaves(spark, d):
    return H.merge_leaves(_nodes(spark, d))


@query(f"WITH {LEVEL}{_merged(True)} SELECT doc_id, node, text FROM merged")
def merge_leaves_fixed(spark, d):
    return H.merge_leaves(_nodes(spark, d), fixed=True)


SECTIONS = LEVEL + _merged(False) + r""", sraw AS (
  SELECT n.doc_id, n.depth, n.parent, n.node, n.name AS text FROM nodes n JOIN levels v ON v.doc_id = n.doc_id AND v.level = 0 WHERE n.depth = 2 OR (n.depth = 1 AND NOT EXISTS (SELECT 1 FROM nodes l WHERE l.doc_id = n.doc_id AND l.depth = 2 AND l.parent = n.node))
  UNION ALL SELECT doc_id, 1, -1, node, text FROM merged
  UNION ALL SELECT doc_id, 0, -1, min(node), min_by(name, node) FROM nodes WHERE depth = 0 GROUP BY doc_id),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY depth, parent, node) - 1 AS sec_ord, text, len(regexp_extract_all(text, '\S+')) AS length FROM sraw)"""


@query(f"WITH {SECTIONS} SELECT doc_id, sec_ord, text, length::BIGINT AS length FROM sections")
def leaf_sections(spark, d):
    return H.leaf_sections(_nodes(spark, d))


@query(f"WITH {SECTIONS} SELECT doc_id, quantile_cont(length::DOUBLE, 0.75) AS threshold FROM sections GROUP BY doc_id")
def section_threshold(spark, d):
    return H.section_threshold(H.leaf_sections(_nodes(spark, d)))


@query(f"""WITH {SECTIONS}, th AS (SELECT s.*, length >= (SELECT quantile_cont(x.length::DOUBLE, 0.75) FROM sections x WHERE x.doc_id = s.doc_id) AS long FROM sections s),
g AS (SELECT *, coalesce(sum(long::INT) OVER (PARTITION BY doc_id ORDER BY sec_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM th),
a AS (SELECT doc_id, grp, count(*) FILTER (WHERE NOT long) AS n_short, count(*) FILTER (WHERE long) AS n_long, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY sec_ord) FILTER (WHERE NOT long) AS short, max(text) FILTER (WHERE long) AS body FROM g GROUP BY ALL)
SELECT doc_id, grp::BIGINT AS grp, CASE WHEN n_short > 0 THEN chr(10) || short || chr(10) || body ELSE body END AS text FROM a WHERE n_long > 0""")
def short_section_carry(spark, d):
    return H.carry_short(H.leaf_sections(_nodes(spark, d)))


@query()
def chunks(spark, d):
    return H.chunk(H.carry_short(H.leaf_sections(_nodes(spark, d)))).select(DOC, "chunk_index", "text", "page")


@query()
def recursive_split(spark, d):
    t = I.table(spark, d, "documents").select(DOC, F.posexplode(recursive_split_udf(1000, 100)(F.col("text"))).alias("part", "text"))
    return t


_JSON_NAME = """'{{"name":' || to_json({0})::VARCHAR"""


@query(rf"""WITH {NODES}, leaves AS (SELECT doc_id, parent AS node, string_agg({_JSON_NAME.format('name')} || '}}', ',' ORDER BY node) AS kids FROM nodes WHERE depth = 2 GROUP BY ALL)
SELECT t.doc_id, '{{"name":"[Page:0] Document Root","children":[' || string_agg({_JSON_NAME.format('t.name')} || coalesce(',"children":[' || l.kids || ']', '') || '}}', ',' ORDER BY t.node) || ']}}' AS structure
FROM nodes t LEFT JOIN leaves l ON l.doc_id = t.doc_id AND l.node = t.node WHERE t.depth < 2 GROUP BY t.doc_id""")
def structure_json(spark, d):
    return H.structure_json(_nodes(spark, d))


CARRY = I.ELEMENTS + ", " + I.EVIDENCE + r""", own AS (SELECT *, try_cast(nullif(regexp_extract(quote, '^\[Page:\s*(\d+)\s*\]', 1), '') AS BIGINT) AS own FROM evidence),
carried AS (SELECT *, last_value(nullif(own, 0) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hint FROM own)"""


def _carried(spark, d):
    return E.carry_page(I.evidence(spark, d), DOC, "ev", "quote")


@query(f"WITH {CARRY} SELECT doc_id, ev, own, hint FROM carried")
def page_forward_fill(spark, d):
    return _carried(spark, d).select(DOC, *L("ev", "own", "hint"))


@query(f"WITH {CARRY} SELECT doc_id, ev, quote FROM evidence WHERE len(regexp_extract_all(quote, '\\S+')) >= 5")
def evidence_min_words(spark, d):
    return E.enough_words(I.evidence(spark, d), "quote").select(DOC, *L("ev"), "quote")


MATCH = CARRY + ", " + I.NORM_BLOCKS + r""", q AS (SELECT doc_id, ev, quote, own, coalesce(own, hint) AS hint, array_to_string(regexp_extract_all(regexp_replace(quote, '^\[Page:\s*\d+\]\s*', ''), '\S+'), ' ') AS nq FROM carried),
cand AS (SELECT q.*, b.block, b.page, b.norm_text, q.hint >= 1 AND EXISTS (SELECT 1 FROM norm_blocks k WHERE k.doc_id = q.doc_id AND k.page = q.hint) AS use FROM q JOIN norm_blocks b USING (doc_id)),
lim AS (SELECT *, CASE WHEN use THEN CASE WHEN page = hint THEN -1 ELSE page END ELSE 0 END AS page_rank FROM cand WHERE NOT coalesce(use, false) OR page BETWEEN hint - 2 AND hint + 2),
hit AS (SELECT doc_id, ev, page, block, row_number() OVER (PARTITION BY doc_id, ev ORDER BY page_rank, block) AS n FROM lim WHERE contains(norm_text, nq) AND length(nq) > 0)"""


def _hinted(spark, d):
    return _carried(spark, d).select(DOC, "ev", text.strip_page(F.col("quote")).alias("quote"), F.col("quote").alias("marked"), "own", F.coalesce("own", "hint").alias("hint"))


@query(f"WITH {MATCH} SELECT doc_id, ev, page, block FROM hit WHERE n = 1")
def evidence_contains_match(spark, d):
    return E.contains_match(_hinted(spark, d).drop("marked", "own"), I.norm_blocks(spark, d)).select(DOC, *L("ev", "page", "block"))


@query()
def evidence_fuzzy_match(spark, d):
    e = _hinted(spark, d).drop("marked", "own").withColumn("quote", F.regexp_replace("quote", "e", "a"))
    return E.fuzzy_match(e, I.norm_blocks(spark, d))


@query(f"""WITH {MATCH} SELECT c.doc_id, c.ev, CASE WHEN h.page IS NOT NULL THEN CASE WHEN c.own = h.page THEN c.quote ELSE '[Page:' || h.page || '] ' || regexp_replace(c.quote, '^\\[Page:\\s*\\d+\\]\\s*', '') END
  WHEN c.own IS NOT NULL THEN c.quote ELSE '[Page:' || coalesce(c.hint, 0) || '] ' || regexp_replace(c.quote, '^\\[Page:\\s*\\d+\\]\\s*', '') END AS shown FROM carried c LEFT JOIN hit h ON h.doc_id = c.doc_id AND h.ev = c.ev AND h.n = 1""")
def evidence_display_text(spark, d):
    c = _carried(spark, d)
    m = E.contains_match(_hinted(spark, d).drop("marked", "own"), I.norm_blocks(spark, d)).select(DOC, "ev", F.col("page").alias("matched"))
    return c.join(m, [DOC, "ev"], "left").select(DOC, *L("ev"), E.display_text(F.col("own"), F.col("hint"), F.col("matched"), F.col("quote")).alias("shown"))


@query(f"""WITH {CARRY} SELECT doc_id, string_agg(n || '. ' || quote || chr(10) || chr(10), '' ORDER BY n) AS listing FROM (SELECT doc_id, quote, row_number() OVER (PARTITION BY doc_id ORDER BY ev) AS n FROM evidence) GROUP BY doc_id""")
def evidence_numbered(spark, d):
    g = I.evidence(spark, d).groupBy(DOC).agg(F.array_sort(F.collect_list(F.struct("ev", "quote"))).alias("q"))
    return g.select(DOC, F.array_join(F.transform("q", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["quote"], F.lit("\n\n"))), "").alias("listing"))


PAGES = r""", pages_text AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY pos) AS page_text FROM elements GROUP BY ALL)"""


@query(f"""WITH {CARRY}{PAGES}, q AS (SELECT e.doc_id, e.ev, regexp_replace(regexp_replace(e.quote, 'x', 'xy'), '\\[Page:\\s*\\d+\\]\\s*', '') AS bare, p.page_text FROM evidence e JOIN pages_text p ON p.doc_id = e.doc_id AND p.page = e.src_page),
w AS (SELECT *, regexp_extract_all(bare, '\\S+') AS ws FROM q)
SELECT doc_id, ev, CASE WHEN contains(page_text, bare) THEN 'exact' WHEN contains(page_text, array_to_string(ws, ' ')) THEN 'normalised'
  WHEN len(ws) > 10 AND len(list_filter(list_transform(range(0, len(ws) - 5), lambda i: array_to_string(ws[i + 1 : i + 8], ' ')), lambda p: length(p) > 15 AND contains(page_text, p))) > 0 THEN 'phrases'
  WHEN len(list_filter(list_transform(string_split(bare, '.'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 15 AND contains(page_text, s))) > 0 THEN 'sentences'
  WHEN ev % 2 = 0 THEN 'box' ELSE 'none' END AS method FROM w""")
def highlight_ladder(spark, d):
    e = I.evidence(spark, d).withColumn("quote", F.regexp_replace("quote", "(?s)^(.*?)x", "$1xy"))
    p = I.elements(spark, d).groupBy(DOC, F.col("page").alias("src_page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("page_text"))
    return e.join(p, [DOC, "src_page"]).select(DOC, *L("ev"), E.highlight(F.col("quote"), F.col("page_text"), F.col("ev") % 2 == 0).alias("method"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BARE = rf"(CASE WHEN regexp_replace(translate({{0}}, '{_UP}', '{_LOW}'), '^[^\p{{{{L}}}}\p{{{{N}}}}]+|[^\p{{{{L}}}}\p{{{{N}}}}]+$', '', 'g') = '' THEN translate({{0}}, '{_UP}', '{_LOW}') ELSE regexp_replace(translate({{0}}, '{_UP}', '{_LOW}'), '^[^\p{{{{L}}}}\p{{{{N}}}}]+|[^\p{{{{L}}}}\p{{{{N}}}}]+$', '', 'g') END)"


@query(rf"""WITH {I.WORDS}, {I.REGIONS},
pw AS (SELECT doc_id, page, pos, text AS raw, {_BARE.format('text')} AS bare, row_number() OVER (PARTITION BY doc_id, page ORDER BY word_no) - 1 AS spot, x0, y0, x1, y1 FROM words),
pg AS (SELECT doc_id, page, list(raw ORDER BY spot) AS raw, list(bare ORDER BY spot) AS bare FROM pw GROUP BY ALL),
q AS (SELECT doc_id, page, pos AS ev, regexp_extract_all(CASE pos % 5 WHEN 0 THEN text WHEN 1 THEN '"' || translate(text, '{_LOW}', '{_UP}') || '"' WHEN 2 THEN 'zzq ' || text || ' zzq' WHEN 3 THEN 'zzq. ' || text || ' zzq' ELSE reverse(text) END, '\S+') AS w FROM elements),
parts AS (SELECT doc_id, page, ev, 0 AS rung, 'raw' AS form, w FROM q UNION ALL
  SELECT doc_id, page, ev, 1, 'bare', list_transform(w, lambda x: {_BARE.format('x')}) FROM q UNION ALL
  SELECT doc_id, page, ev, 2, 'bare', list_transform(p, lambda x: {_BARE.format('x')}) FROM (SELECT doc_id, page, ev, unnest(list_transform(range(0, len(w) - 5), lambda i: w[i + 1 : i + 8])) AS p FROM q WHERE len(w) > 10) WHERE length(array_to_string(p, ' ')) > 15 UNION ALL
  SELECT doc_id, page, ev, 3, 'bare', list_transform(regexp_extract_all(p, '\S+'), lambda x: {_BARE.format('x')}) FROM (SELECT doc_id, page, ev, unnest(string_split(array_to_string(w, ' '), '.')) AS p FROM q WHERE contains(array_to_string(w, ' '), '.')) WHERE length(regexp_replace(p, '^\s+|\s+$', '', 'g')) > 15),
runs AS (SELECT doc_id, page, form, size, unnest(range(0, len(w) - size + 1)) AS spot, unnest(list_transform(range(0, len(w) - size + 1), lambda i: array_to_string(w[i + 1 : i + size], ' '))) AS run
  FROM (SELECT doc_id, page, 'raw' AS form, raw AS w FROM pg UNION ALL SELECT doc_id, page, 'bare', bare FROM pg), range(1, 9) s(size) WHERE len(w) >= size),
met AS (SELECT p.*, r.spot FROM parts p JOIN runs r ON r.doc_id = p.doc_id AND r.page = p.page AND r.form = p.form AND r.size = least(len(p.w), 8) AND r.run = array_to_string(p.w[1:8], ' ')),
hits AS (SELECT doc_id, page, ev, rung, len(w) AS n, spot FROM met WHERE len(w) <= 8 UNION ALL
  SELECT m.doc_id, m.page, m.ev, m.rung, len(w), spot FROM met m JOIN pg USING (doc_id, page) WHERE len(w) > 8 AND CASE form WHEN 'raw' THEN pg.raw ELSE pg.bare END[spot + 1 : spot + len(w)] = w),
best AS (SELECT doc_id, page, ev, min(rung) AS best FROM hits GROUP BY ALL),
spots AS (SELECT DISTINCT doc_id, page, ev, best, unnest(range(spot, spot + n)) AS spot FROM hits JOIN best USING (doc_id, page, ev) WHERE rung = best OR rung >= 2 AND best >= 2),
seen AS (SELECT s.*, pos, x0, y0, x1, y1, s.spot - row_number() OVER (PARTITION BY s.doc_id, s.page, s.ev, pos ORDER BY s.spot) AS run FROM spots s JOIN pw USING (doc_id, page, spot)),
rects AS (SELECT doc_id, page, ev, best, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM seen GROUP BY doc_id, page, ev, best, pos, run)
SELECT q.doc_id, q.ev, q.page, CASE best WHEN 0 THEN 'exact' WHEN 1 THEN 'normalised' WHEN 2 THEN 'phrases' WHEN 3 THEN 'sentences' ELSE CASE WHEN q.ev % 2 = 0 THEN 'box' ELSE 'none' END END AS method,
  best IS NOT NULL OR q.ev % 2 = 0 AS found, coalesce(r.x0, b.x0) AS x0, coalesce(r.y0, b.y0) AS y0, coalesce(r.x1, b.x1) AS x1, coalesce(r.y1, b.y1) AS y1
FROM q LEFT JOIN rects r ON r.doc_id = q.doc_id AND r.page = q.page AND r.ev = q.ev LEFT JOIN regions b ON b.doc_id = q.doc_id AND b.region_ord = q.ev AND q.ev % 2 = 0""")
def quote_rects(spark, d):
    """Rectangles to mark for every element's text as a quote, in five forms by turns: as it is, in capitals and quotation marks, between foreign words, behind a foreign sentence, and backwards."""
    e, c = I.elements(spark, d), F.col("text")
    forms = (c, F.concat(F.lit('"'), F.translate(c, _LOW, _UP), F.lit('"')), F.concat(F.lit("zzq "), c, F.lit(" zzq")), F.concat(F.lit("zzq. "), c, F.lit(" zzq")))
    quote = F.reverse(c)
    for i, form in enumerate(forms):
        quote = F.when(F.col("pos") % 5 == i, form).otherwise(quote)
    mark = F.concat(F.lit("[Page:"), F.col("page").cast("string"), F.lit("] "))
    boxes = I.regions(spark, d).filter("region_ord % 2 = 0").select(DOC, F.col("region_ord").alias("ev"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    quotes = e.select(DOC, F.col("pos").alias("ev"), "page", F.concat(mark, quote).alias("quote"))
    known = quotes.drop("quote").join(boxes, [DOC, "ev"], "left").withColumn("boxes", F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    found = E.annotation_rows(P.with_known(known, P.quote_places(quotes, I.words(spark, d), line="pos")), keep=("method",))
    return found.select(DOC, *L("ev", "page"), "method", "found", "rect.*")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(0, len(ws) - 5), lambda i: array_to_string(ws[i + 1 : i + 8], ' '))) AS p FROM w WHERE len(ws) > 10)
SELECT doc_id, count(*) AS n_phrases, sum(length(p))::BIGINT AS n_chars FROM p WHERE length(p) > 15 GROUP BY doc_id""")
def phrase_windows(spark, d):
    p = I.table(spark, d, "documents").select(DOC, F.explode(text.phrases(F.col("text"))).alias("p"))
    return p.groupBy(DOC).agg(F.count("*").alias("n_phrases"), F.sum(F.length("p")).alias("n_chars"))


@query(f"""WITH {I.ELEMENTS}, o AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos) - length(text) AS off FROM elements),
ov AS (SELECT doc_id, c, page, sum(least(off + length(text), (c + 1) * 500) - greatest(off, c * 500)) AS n FROM (SELECT *, unnest(range(CAST(off // 500 AS BIGINT), CAST((off + length(text) - 1) // 500 AS BIGINT) + 1)) AS c FROM o) GROUP BY ALL)
SELECT doc_id, c AS chunk_index, arg_min(page, (-n, page)) AS page FROM ov GROUP BY doc_id, c""")
def chunk_predominant_page(spark, d):
    return H.predominant_page(I.elements(spark, d), 500).select(DOC, *L("chunk_index", "page"))


@query(f"""WITH {I.ELEMENTS}, {I.REGIONS}, o AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY pos) - length(text) AS off FROM elements),
ov AS (SELECT doc_id, pos, page, c, least(off + length(text), (c + 1) * 500) - greatest(off, c * 500) AS n FROM (SELECT *, unnest(range(CAST(off // 500 AS BIGINT), CAST((off + length(text) - 1) // 500 AS BIGINT) + 1)) AS c FROM o)),
best AS (SELECT doc_id, c, arg_min(page, (-n, page)) AS page FROM (SELECT doc_id, c, page, sum(n) AS n FROM ov GROUP BY ALL) GROUP BY doc_id, c)
SELECT DISTINCT b.doc_id, b.c AS chunk_index, b.page, x0, y0, x1, y1 FROM best b JOIN ov USING (doc_id, c, page) JOIN regions r ON r.doc_id = b.doc_id AND r.region_ord = ov.pos""")
def chunk_page_boxes(spark, d):
    """Boxes of each chunk's main page."""
    boxes = I.regions(spark, d).select(DOC, F.col("region_ord").alias("pos"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    got = H.chunk_page_boxes(I.elements(spark, d).join(boxes, [DOC, "pos"]), 500)
    return got.select(DOC, *L("chunk_index", "page"), F.inline("boxes"))


@query(f"WITH {I.ELEMENTS}, e AS (SELECT e.*, max(page) OVER (PARTITION BY doc_id) AS last FROM elements e) SELECT doc_id, pos FROM e WHERE page + pos % 3 <= last")
def page_range_filter(spark, d):
    e = I.elements(spark, d).withColumn("asked", F.col("page") + F.col("pos") % 3)
    return B.in_page_range(e, "asked", "page").select(DOC, *L("pos"))


@query()
def raster_regions(spark, d):
    """Regions of pages painted from words, 40 to a line, with a gap before each element."""
    w = P.placed_words(I.words(spark, d), [DOC, "page"], "word_no")
    x, y = 12.0 * (F.col("at") % 40), 16.0 * F.floor(F.col("at") / 40) + 24.0 * (F.col("pos") % 10)
    boxes = w.select(DOC, "page", x.alias("x0"), y.alias("y0"), (x + F.least(F.length("text"), F.lit(11))).alias("x1"), (y + 10.0).alias("y1"))
    return G.raster_regions(boxes).select(DOC, *L("page", "region"), "x0", "y0", "x1", "y1")
