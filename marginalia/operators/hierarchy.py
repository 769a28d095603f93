"""Heading hierarchy, sections and chunks of documents.

Elements (doc_id, pos, page, text, height) become parents and leaves: an
element's span is the number of smaller ones that follow before the next as
high.  Elements with a span are parents (level 1, in document order); the
others are leaves (level 2) of the last taller element, or dropped if there is
none.  A document without parents is flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count, ws_strip
from .folds import recursive_split_udf, span_parent_udf

PAGE_LINE = r"^\[Page:\s*(\d+)\s*\]\s*(.*)"


def spans(elements: DataFrame, doc: str = "doc_id", order: str = "pos", height: str = "height") -> DataFrame:
    """Adds span and parent (its order value, null without one).

    Linear in a document's elements: heights and order values go to Python as
    two arrays.  The result stays dealt by document, so windows over one follow
    without a shuffle.
    """
    others = [c for c in elements.columns if c != doc]
    rows = elements.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.struct(*others).alias("row")))).alias("r"))
    got = rows.withColumn("g", span_parent_udf(F.transform("r", lambda x: x["row"][height].cast("double")), F.transform("r", lambda x: x["row"][order].cast("long"))))
    each = got.select(doc, F.explode(F.arrays_zip(F.col("r.row").alias("row"), F.col("g.span").alias("span"), F.col("g.parent").alias("parent"))).alias("e"))
    return each.select(*[F.col(f"e.row.{c}").alias(c) if c != doc else F.col(doc) for c in elements.columns], F.col("e.span").alias("span"), F.col("e.parent").alias("parent"))


def node_name(page: Column, text: Column) -> Column:
    return F.concat(F.lit("[Page:"), page.cast("string"), F.lit("] "), ws_strip(text))


def tree(elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Nodes: doc, node (order), parent (-1: root), depth (1, 2), name; flat documents have only roots at depth 0."""
    s = spans(elements, doc)
    parents = F.sum((F.col("span") > 0).cast("long")).over(Window.partitionBy(doc))
    s = s.withColumn("parents", parents)
    depth = F.when(F.col("parents") == 0, 0).when(F.col("span") > 0, 1).when(F.col("parent").isNotNull(), 2)
    return s.withColumn("depth", depth.cast("long")).filter("depth is not null").select(
        doc, F.col("pos").cast("long").alias("node"), F.when(F.col("depth") == 2, F.col("parent")).otherwise(-1).cast("long").alias("parent"), "depth", node_name(F.col("page"), F.col("text")).alias("name")
    )


def depth_histogram(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Nodes at each depth below the root, which counts at depth 0; of a flat document only the first is visited."""
    first = F.min("node").over(Window.partitionBy(doc))
    kept = nodes.withColumn("__f", first).filter("depth > 0 or node = __f")
    counts = kept.groupBy(doc, "depth").agg(F.count("*").alias("n_nodes"))
    roots = nodes.filter("depth = 1").select(doc, F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("n_nodes")).distinct()
    return counts.unionByName(roots)


def content_level(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """0 if a document has at least as many parents as leaves, else 1."""
    c = nodes.filter("depth > 0").groupBy(doc).agg(F.count_if(F.col("depth") == 1).alias("n_parents"), F.count_if(F.col("depth") == 2).alias("n_leaves"))
    return c.withColumn("level", F.when(F.col("n_parents") >= F.col("n_leaves"), 0).otherwise(1).cast("long"))


def _families(nodes: DataFrame, doc: str) -> DataFrame:
    """A row for each parent (or root of a flat document): doc, node, name, depth, kids (node, name), level, first.

    One grouping by (doc, parent), and the counts as windows over the document:
    nodes dealt by document need no shuffle.
    """
    own = F.when(F.col("depth") == 2, F.col("parent")).otherwise(F.col("node"))
    top = F.col("depth") < 2
    kids = F.array_sort(F.collect_list(F.when(~top, F.struct("node", "name"))))
    g = nodes.groupBy(doc, own.alias("top")).agg(F.max(F.when(top, F.col("name"))).alias("name"), F.min("depth").alias("depth"), kids.alias("kids"))
    w = Window.partitionBy(doc)
    level = F.when(F.count("*").over(w) >= F.sum(F.size("kids")).over(w), 0).otherwise(1)
    return g.withColumnRenamed("top", "node").withColumns({"level": level.cast("long"), "first": F.min("node").over(w)})


def _merged(name: Column, kids: Column, fixed: bool) -> Column:
    page = lambda c: F.regexp_extract(c, r"^\[Page:\s*(\d+)\s*\]", 1)
    drop = r"^\[Page:\s*(\d+)\s*\]\s*" if fixed else PAGE_LINE
    part = lambda k: F.when(page(k["name"]) == page(name), ws_strip(F.regexp_replace(k["name"], drop, ""))).otherwise(k["name"])
    return F.array_join(F.concat(F.array(name), F.filter(F.transform(kids, part), lambda x: F.length(x) > 0)), " ")


def merge_leaves(nodes: DataFrame, doc: str = "doc_id", fixed: bool = False) -> DataFrame:
    """Parents with their leaves' texts, in documents whose level is 1.

    A leaf on its parent's page loses its first line with the page mark; with
    fixed it loses the mark only.
    """
    f = _families(nodes, doc).filter("depth = 1 and level = 1")
    return f.select(doc, "node", _merged(F.col("name"), F.col("kids"), fixed).alias("text"))


def leaf_sections(nodes: DataFrame, doc: str = "doc_id", fixed: bool = False) -> DataFrame:
    """Sections in breadth-first order: doc, sec_ord, text, length (words).

    Level 1 documents give their merged parents; level 0 documents their
    leaves and the parents without leaves; flat documents their first node.
    """
    f = _families(nodes, doc).filter("depth > 0 or node = first")
    section = lambda depth, parent, node, text: F.struct(F.lit(depth).cast("long").alias("depth"), parent.cast("long").alias("parent"), node.alias("node"), text.alias("text"))
    none = F.lit(-1)
    rows = (
        F.when(F.col("depth") == 0, F.array(section(0, none, F.col("node"), F.col("name"))))
        .when(F.col("level") == 1, F.array(section(1, none, F.col("node"), _merged(F.col("name"), F.col("kids"), fixed))))
        .when(F.size("kids") == 0, F.array(section(1, none, F.col("node"), F.col("name"))))
        .otherwise(F.transform("kids", lambda k: section(2, F.col("node"), k["node"], k["name"])))
    )
    s = f.select(doc, F.explode(rows).alias("s")).select(doc, "s.*")
    w = Window.partitionBy(doc).orderBy("depth", "parent", "node")
    return s.select(doc, (F.row_number().over(w) - 1).cast("long").alias("sec_ord"), "text", word_count(F.col("text")).alias("length"))


def section_threshold(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """75th percentile (linear) of section lengths."""
    return sections.groupBy(doc).agg(F.percentile(F.col("length").cast("double"), 0.75).alias("threshold"))


def carry_short(sections: DataFrame, doc: str = "doc_id", keep_tail: bool = False) -> DataFrame:
    """Sections under the threshold join the next that isn't: doc, group, text.

    Short sections at the end are lost unless keep_tail.
    """
    s = sections.withColumn("threshold", F.percentile(F.col("length").cast("double"), 0.75).over(Window.partitionBy(doc)))
    w = Window.partitionBy(doc).orderBy("sec_ord").rowsBetween(Window.unboundedPreceding, -1)
    long = F.col("length") >= F.col("threshold")
    s = s.withColumns({"long": long, "grp": F.coalesce(F.sum(long.cast("long")).over(w), F.lit(0).cast("long"))})
    g = s.groupBy(doc, "grp").agg(
        F.array_sort(F.collect_list(F.when(~F.col("long"), F.struct("sec_ord", "text")))).alias("short"), F.max(F.when(F.col("long"), F.col("text"))).alias("body"), F.count_if("long").alias("n_long")
    )
    before = F.array_join(F.transform("short", lambda x: ws_strip(x["text"])), "\n")
    text = F.when(F.size("short") > 0, F.concat(F.lit("\n"), before, F.when(F.col("n_long") > 0, F.concat(F.lit("\n"), F.col("body"))).otherwise(""))).otherwise(F.col("body"))
    return (g if keep_tail else g.filter("n_long > 0")).select(doc, "grp", text.alias("text"))


def chunk(texts: DataFrame, doc: str = "doc_id", size: int = 50_000, overlap: int = 100, source: str = "structured") -> DataFrame:
    """Texts split recursively, with a running index and metadata."""
    parts = texts.select(doc, "grp", F.posexplode(recursive_split_udf(size, overlap)(F.col("text"))).alias("p", "text"))
    w = Window.partitionBy(doc).orderBy("grp", "p")
    return parts.select(
        doc, (F.row_number().over(w) - 1).cast("int").alias("chunk_index"), "text", F.lit(0).alias("page"),
        F.create_map(F.lit("source"), F.lit(source), F.lit("chunk_type"), F.lit("hierarchical")).alias("metadata"),
    )


def chunk_overlaps(elements: DataFrame, size: int, doc: str = "doc_id", order: str = "pos", text: str = "text") -> DataFrame:
    """elements with chunk_index, once for each run of `size` characters of the strung-together texts they lie in, and the characters __n there."""
    o = elements.withColumn("__n", F.length(text)).withColumn("__at", F.sum("__n").over(Window.partitionBy(doc).orderBy(order)) - F.col("__n"))
    o = o.withColumn("chunk_index", F.explode(F.sequence(F.floor(F.col("__at") / size), F.floor((F.col("__at") + F.col("__n") - 1) / size))))
    part = F.least(F.col("__at") + F.col("__n"), (F.col("chunk_index") + 1) * size) - F.greatest("__at", F.col("chunk_index") * size)
    return o.withColumn("__n", part).drop("__at")


def predominant_page(elements: DataFrame, size: int, doc: str = "doc_id", order: str = "pos", page: str = "page", text: str = "text") -> DataFrame:
    """doc, chunk_index, page: of each run of `size` characters of the strung-together texts the page that gives most of them (ties: the first)."""
    share = chunk_overlaps(elements, size, doc, order, text).groupBy(doc, "chunk_index", page).agg(F.sum("__n").alias("__n"))
    return share.groupBy(doc, "chunk_index").agg(F.min_by(page, F.struct(-F.col("__n"), F.col(page))).alias(page))


def chunk_page_boxes(elements: DataFrame, size: int, doc: str = "doc_id", order: str = "pos", page: str = "page", text: str = "text", box: str = "box") -> DataFrame:
    """doc, chunk_index, page (that gives most of the chunk), boxes: of the chunk's elements on that page, each once, in order.

    One aggregate by page, then one by chunk, on one partitioning; a chunk's boxes are bounded by its characters.
    """
    rows = chunk_overlaps(elements, size, doc, order, text)
    per = rows.groupBy(doc, "chunk_index", page).agg(F.sum("__n").alias("__n"), F.collect_list(F.struct(F.col(order).alias("o"), F.col(box).alias("b"))).alias("__b"))
    best = per.groupBy(doc, "chunk_index").agg(F.min_by(F.struct(F.col(page).alias("p"), "__b"), F.struct(-F.col("__n"), F.col(page))).alias("m"))
    boxes = F.array_distinct(F.transform(F.array_sort("m.__b"), lambda x: x["b"]))
    return best.select(doc, "chunk_index", F.col("m.p").alias(page), F.filter(boxes, lambda b: b.isNotNull()).alias("boxes"))


def structure_json(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Nested JSON of each document's tree."""
    leaves = nodes.filter("depth = 2").groupBy(doc, F.col("parent").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "name"))), lambda x: F.struct(x["name"].alias("name"))).alias("children"))
    top = nodes.filter("depth < 2").join(leaves, [doc, "node"], "left")
    kids = F.transform(F.array_sort(F.collect_list(F.struct("node", "name", "children"))), lambda x: F.struct(x["name"].alias("name"), x["children"].alias("children")))
    return top.groupBy(doc).agg(F.to_json(F.struct(F.lit("[Page:0] Document Root").alias("name"), kids.alias("children"))).alias("structure"))
