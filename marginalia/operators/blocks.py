"""Words, regions, blocks and elements of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_ws, ws_strip
from .folds import merge_boxes_udf, merge_pixels_udf, merge_words_udf


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.length(ws_strip(F.col(text))) > 0)


def digit_class() -> str:
    """A regular-expression class of all digits: decimal ones, and those in circles, superscript and the like."""
    others = [i for i in range(0x110000) if (c := chr(i)).isdigit() and not c.isdecimal()]
    return r"[\p{Nd}" + "".join(rf"\x{{{i:X}}}" for i in others) + "]"


def drop_numeric(df: DataFrame, text: str = "text") -> DataFrame:
    """Blocks that are digits only go."""
    return df.filter(~F.col(text).rlike(f"^{digit_class()}+$"))


def resolve_aliases(df: DataFrame) -> DataFrame:
    """text or content, page or page_num; rows that lack either go; norm_text is added."""
    text = F.coalesce(F.nullif("text", F.lit("")), F.col("content"))
    out = df.withColumns({"block_text": text, "block_page": F.coalesce("page", "page_num")}).filter("block_text is not null and block_page is not null")
    return out.withColumn("norm_text", normalize_ws(F.col("block_text")))


def repeated_keys(df: DataFrame, doc: str = "doc_id", text: str = "text", height: str = "height") -> DataFrame:
    """(document, stripped text, height) of non-empty text that occurs more than once."""
    return df.groupBy(doc, ws_strip(F.col(text)).alias("key_text"), F.col(height).alias("key_height")).agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.length("key_text") > 0))


def drop_repeated(df: DataFrame, doc: str = "doc_id", text: str = "text", height: str = "height") -> DataFrame:
    """All copies of repeated elements go; in a document that has repeats, empty ones go too.

    One shuffle by document: the counts are windows within it.
    """
    key = ws_strip(F.coalesce(F.col(text), F.lit("")))
    copies = F.count("*").over(Window.partitionBy(doc, "__key", height))
    marked = df.withColumn("__key", key).repartition(doc).withColumn("__copies", F.when(F.length("__key") > 0, copies).otherwise(1))
    any_repeat = F.max("__copies").over(Window.partitionBy(doc))
    return marked.withColumn("__any", any_repeat).filter("__copies = 1 and (__any = 1 or length(__key) > 0)").drop("__key", "__copies", "__any")


def assign_words(words: DataFrame, regions: DataFrame, page: list[str], word: str, order: str, pad: float = 0.3) -> DataFrame:
    """Each word to the first region in order whose padded box meets its own.

    A page's regions are one array, joined to its words by an equi-join on the
    page; words travel once, and stay dealt by page for what follows.
    """
    names = ("x0", "y0", "x1", "y1")
    boxes = regions.select(*page, F.struct(order, *names).alias("__r")).filter(F.col("__r")[order].isNotNull())
    held = boxes.groupBy(*page).agg(F.array_sort(F.collect_list("__r")).alias("__r"))
    meets = lambda r: (F.col("x0") < r["x1"] + pad) & (F.col("x1") > r["x0"] - pad) & (F.col("y0") < r["y1"] + pad) & (F.col("y1") > r["y0"] - pad)
    first = words.join(held, page, "left").withColumn("__r", F.get(F.filter("__r", meets), F.lit(0))[order])
    # rows that repeat a word's key share its region, one without a key has none
    own = F.when(F.col(word).isNotNull(), F.min("__r").over(Window.partitionBy(*page, word)))
    return first.withColumn(order, own).drop("__r")


def assemble_text(words: DataFrame, keys: list[str], factor: float = 0.6) -> DataFrame:
    """Text, median and smallest height of each region's words in reading order.

    A word on about the same line follows after a blank, else a newline.
    """
    w = Window.partitionBy(*keys).orderBy("y0", "x0", "word_no")
    h = F.col("y1") - F.col("y0")
    near = F.abs(F.lag("y0").over(w) - F.col("y0")) < F.when(h > 0, factor * h).otherwise(2.0)
    sep = F.when(F.row_number().over(w) == 1, "").when(near, " ").otherwise("\n")
    rows = words.withColumns({"sep": sep, "n": F.row_number().over(w), "h": h})
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sep", "text"))), lambda x: F.concat(x["sep"], x["text"])), "")
    tall = F.when(F.col("h") > 0, F.col("h"))
    return rows.groupBy(*keys).agg(text.alias("block_text"), F.coalesce(F.median(tall), F.lit(0.0)).alias("height_median"), F.coalesce(F.min(tall), F.lit(0.0)).cast("double").alias("height_min"))


def large_regions(regions: DataFrame, width: float, height: float, half: bool = False) -> DataFrame:
    """Regions of at least this size; half of it before they are merged."""
    k = 0.5 if half else 1.0
    return regions.filter((F.col("x1") - F.col("x0") >= k * width) & (F.col("y1") - F.col("y0") >= k * height))


def multicolumn_rank(x0: Column, x1: Column, page_width: Column) -> Column:
    """0 for wide boxes across the centre, 1 left, 2 right."""
    mid, tolerance = page_width / 2, page_width * 0.05
    crosses = (x0 < mid + tolerance / 2) & (x1 > mid - tolerance / 2)
    return F.when(crosses & (x1 - x0 > page_width * 0.6), 0).when((x0 + x1) / 2 < mid, 1).otherwise(2)


FEATURES = (
    "n_boxes", "width_median", "width_std", "height_median", "height_std", "x_centre_median", "x_centre_std", "y_centre_median",
    "y_centre_std", "width_share", "aspect_median", "width_norm_median", "x_centre_norm_median",
)


def reading_order(rows: DataFrame, keys: list[str], tie: str, bucket: str | None = None, page: str | None = None, name: str = "reading_order") -> DataFrame:
    """Adds the place from 1 in reading order: page, column bucket, top, left."""
    order = [c for c in (page, bucket) if c] + ["y0", "x0", tie]
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def in_page_range(rows: DataFrame, asked: str, page: str, doc: str = "doc_id") -> DataFrame:
    """Rows whose asked page exists in their document (pages count from 0)."""
    n = rows.groupBy(doc).agg((F.max(page) + 1).alias("__pages"))
    return rows.join(n, doc).filter(F.col(asked) < F.col("__pages")).drop("__pages")


def bounding_boxes(boxes: DataFrame, keys: list) -> DataFrame:
    """The smallest box around each group's boxes."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def layout_features(boxes: DataFrame, keys: list[str], page_width: float) -> DataFrame:
    """13 features of the boxes of each page; boxes travel as they are, which is less than medians' partial counts."""
    boxes = boxes.select(*keys, "x0", "y0", "x1", "y1").repartition(*keys)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    xc, yc = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return boxes.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n_boxes"),
        F.median(w).alias("width_median"), F.stddev_pop(w).alias("width_std"), F.median(h).alias("height_median"), F.stddev_pop(h).alias("height_std"),
        F.median(xc).alias("x_centre_median"), F.stddev_pop(xc).alias("x_centre_std"), F.median(yc).alias("y_centre_median"), F.stddev_pop(yc).alias("y_centre_std"),
        (F.sum(w) / page_width).alias("width_share"), F.median(F.when(h == 0, 0.0).otherwise(w / h)).alias("aspect_median"),
        (F.median(w) / page_width).alias("width_norm_median"), (F.median(xc) / page_width).alias("x_centre_norm_median"),
    )


def document_features(pages: DataFrame, doc: str = "doc_id", page: str = "page", first_pages: int = 5, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Means of the page features over a document's first pages."""
    return pages.filter(F.col(page) < first_pages).groupBy(doc).agg(*[F.avg(c).alias(c) for c in columns])


def merge_word_blocks(words: DataFrame, page: list[str], order: list[str], width: float | str, height: float | str) -> DataFrame:
    """Word runs of one height as blocks, page by page; thresholds follow each page's size (numbers or columns) and orientation."""
    w, h = (F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in (width, height))
    size = [F.max(w).alias("pw"), F.max(h).alias("ph")]
    rows = drop_blank(words).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*order, "x0", "y0", "x1", "y1", "text"))).alias("w"), *size)
    wide = F.when(F.col("pw") > F.col("ph"), 0.02).otherwise(0.0092625) * F.col("pw")
    high = F.when(F.col("pw") > F.col("ph"), 0.01).otherwise(0.05) * F.col("ph")
    cells = F.transform("w", lambda x: F.struct(*[x[c].alias(c) for c in ("x0", "y0", "x1", "y1", "text")]))
    got = rows.select(*page, F.posexplode(merge_words_udf(cells, wide, high)).alias("block_no", "b"))
    return got.select(*page, "block_no", "b.*")


def merge_regions(boxes: DataFrame, keys: list[str], order: list[str], pixels: bool = False) -> DataFrame:
    """Boxes of each page merged to a fix-point (order-dependent)."""
    rows = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "x0", "y0", "x1", "y1"))).alias("b"))
    merged = (merge_pixels_udf if pixels else merge_boxes_udf)(F.transform("b", lambda x: F.struct(*[x[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])))
    return rows.select(*keys, F.posexplode(merged).alias("region_no", "r")).select(*keys, "region_no", "r.*")
