"""Subtitle cues, chapters and time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TIME, is_chapter, srt_ms, srt_time, strip_stamp, ws_strip
from .folds import pack_cues_udf

ARROW = rf"^\s*({TIME})\s*-->\s*({TIME})\s*$"


def parse_srt(files: DataFrame, key: str, text: str = "value") -> DataFrame:
    """Cues of subtitle texts: key, idx, start_ms, end_ms, text, stamped text.

    Blocks need an index, a time line and text.  The first block of an index
    wins, also if its time line is bad.
    """
    blocks = files.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("b", "block"))
    lines = blocks.select(key, "b", F.split(ws_strip(F.col("block")), "\r?\n").alias("l")).filter("size(l) >= 3").withColumn("idx", ws_strip(F.element_at("l", 1)).try_cast("int")).filter("idx is not null")
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy(key, "idx").orderBy("b"))).filter("n = 1")
    start, end = (F.regexp_extract(F.element_at("l", 2), ARROW, i) for i in (1, 2))
    body = F.array_join(F.slice("l", 3, F.size("l")), "\n")
    out = first.withColumns({"s": start, "e": end, "text": body}).filter("s != ''")
    return out.select(key, "idx", srt_ms(F.col("s")).alias("start_ms"), srt_ms(F.col("e")).alias("end_ms"), "text", F.concat(F.lit("["), "s", F.lit(","), "e", F.lit("] "), "text").alias("stamped"))


def format_srt(cues: DataFrame, key: str) -> DataFrame:
    """One subtitle text per key; cues are numbered from 0."""
    g = cues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms", ws_strip(F.col("text")).alias("text")))).alias("c"))
    one = F.transform("c", lambda x, i: F.concat(i.cast("string"), F.lit("\n"), srt_time(x["start_ms"]), F.lit(" --> "), srt_time(x["end_ms"]), F.lit("\n"), x["text"], F.lit("\n")))
    return g.select(key, F.array_join(one, "\n").alias("srt"))


def chapters(cues: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Cues grouped by chapter marks: key, chapter, first and last idx, n_cues."""
    w = Window.partitionBy(key).orderBy("idx")
    mark = is_chapter(strip_stamp(F.col(text))) & (F.row_number().over(w) > 1)
    g = cues.withColumn("mark", mark.cast("long")).withColumn("chapter", F.sum("mark").over(w))
    return g.groupBy(key, "chapter").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_cues"))


def merge_intervals(rows: DataFrame, key: str, order: str, gap_ms: int = 1000) -> DataFrame:
    """Intervals of a key merged where the next starts within gap_ms of the end so far.

    start >= end and missing times are dropped.  Two windows on one partitioning.
    """
    w = Window.partitionBy(key).orderBy("start_ms", order)
    before = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = rows.filter("start_ms < end_ms").withColumn("new", (F.coalesce(F.col("start_ms") - before > gap_ms, F.lit(True))).cast("long"))
    s = s.withColumn("grp", F.sum("new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", order, "text"))), lambda x: x["text"]), " ")
    return s.groupBy(key, "grp").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_parts"), text.alias("text"))


def sane_intervals(rows: DataFrame, start: str = "start_ms", end: str = "end_ms", text: str = "text") -> DataFrame:
    """Rows with both times and a text whose start lies before the end."""
    return rows.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(text).isNotNull() & (F.col(start) < F.col(end)))


def join_close(rows: DataFrame, key: str, start: str = "start", end: str = "end", gap: float = 1.0) -> DataFrame:
    """Runs of intervals in the order of their starts, each beginning within gap of the end of the one before.

    The plain form: a run ends where its last interval does, not at the latest end.
    """
    w = Window.partitionBy(key).orderBy(start)
    new = F.coalesce(F.col(start) - F.lag(end).over(w) > gap, F.lit(True)).cast("long")
    g = rows.withColumn("__new", new).withColumn("grp", F.sum("__new").over(w))
    return g.groupBy(key, "grp").agg(F.min(start).alias(start), F.max_by(end, start).alias(end))


def pack_cues(segments: DataFrame, key: str, order: str) -> DataFrame:
    """Speech segments joined into cues (a fold over each recording)."""
    g = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "start", "end", "text"))).alias("s"))
    got = g.select(key, F.posexplode(pack_cues_udf(F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))))).alias("idx", "c"))
    return got.select(key, "idx", "c.*")


def close_sentences(words: DataFrame, key: str, order: str) -> DataFrame:
    """Words grouped into sentences that end on . ! ? , ; or :"""
    w = Window.partitionBy(key).orderBy(order)
    ended = F.col("text").rlike(r"[.!?,;:]$").cast("long")
    s = words.withColumn("ended", ended).withColumn("before", F.lag("ended", 1, 0).over(w)).withColumn("sent", F.sum("before").over(w))
    return s.groupBy(key, "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("sentence"))
