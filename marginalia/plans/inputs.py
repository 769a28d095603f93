"""Engine inputs derived from the test tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_ws, ws_strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark, sf_dir) -> DataFrame:
    """Lines of documents: doc_id, pos, page, text, height."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.select("doc_id", "pos", F.floor(F.col("pos") / 10).cast("int").alias("page"), "text", (8 + 2 * (F.length("text") % 5)).cast("double").alias("height"))


BLOCKS = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
blocks AS (SELECT doc_id, pos, pos // 10 AS page, text, CAST(8 + 2 * (length(text) % 5) AS DOUBLE) AS height FROM lines)"""


def elements(spark, sf_dir) -> DataFrame:
    """Blocks with text."""
    return blocks(spark, sf_dir).filter(F.length(ws_strip(F.col("text"))) > 0)


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
ELEMENTS = BLOCKS + r""",
elements AS (SELECT * FROM blocks WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0)"""


def words(spark, sf_dir) -> DataFrame:
    """Words of elements with boxes."""
    e = elements(spark, sf_dir)
    w = e.select("doc_id", "page", "pos", "height", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("k", "text"))
    return w.select(
        "doc_id", "page", "pos", (F.col("pos") * 100000 + F.col("k")).cast("long").alias("word_no"), "text",
        (10.0 * F.col("k")).alias("x0"), (12.0 * (F.col("pos") % 10)).alias("y0"), (10.0 * F.col("k") + F.length("text")).alias("x1"), (12.0 * (F.col("pos") % 10) + F.col("height")).alias("y1"),
    )


WORDS = ELEMENTS + r""",
wraw AS (SELECT doc_id, page, pos, height, unnest(regexp_extract_all(text, '\S+')) AS text, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS k FROM elements),
words AS (SELECT doc_id, page, pos, CAST(pos * 100000 + k AS BIGINT) AS word_no, text, 10.0::DOUBLE * k AS x0, 12.0::DOUBLE * (pos % 10) AS y0, 10.0::DOUBLE * k + length(text) AS x1, 12.0::DOUBLE * (pos % 10) + height AS y1 FROM wraw)"""


def regions(spark, sf_dir) -> DataFrame:
    """One box for each element, 60 wide or more, two lines high."""
    e = elements(spark, sf_dir)
    y = 12.0 * (F.col("pos") % 10)
    return e.select("doc_id", "page", F.col("pos").alias("region_ord"), F.lit(0.0).alias("x0"), y.alias("y0"), (F.lit(60.0) + F.length("text") % 40).alias("x1"), (y + 14.0).alias("y1"))


REGIONS = r"""regions AS (SELECT doc_id, page, pos AS region_ord, 0.0::DOUBLE AS x0, 12.0::DOUBLE * (pos % 10) AS y0, 60.0::DOUBLE + length(text) % 40 AS x1, 12.0::DOUBLE * (pos % 10) + 14.0 AS y1 FROM elements)"""


def cues(spark, sf_dir) -> DataFrame:
    """Events of a user as cues; sign-ups carry a chapter mark."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        "user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), ms.alias("start_ms"), (ms + F.floor(F.col("value") * 1000)).cast("long").alias("end_ms"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("Chapter "), F.col("event_id").cast("string"))).otherwise(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))).alias("text"), "value",
    )


CUES = r"""cues AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS end_ms,
  CASE WHEN event_type = 'signup' THEN 'Chapter ' || event_id ELSE event_type || ' ' || event_id END AS text, value FROM events)"""


def evidence(spark, sf_dir) -> DataFrame:
    """Quotes: every element, marked with its page, no page, or 0 by turns."""
    e = elements(spark, sf_dir)
    mark = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("[Page:"), F.col("page").cast("string"), F.lit("] "))).when(F.col("pos") % 3 == 1, "[Page:0] ").otherwise("")
    return e.select("doc_id", F.col("pos").alias("ev"), F.concat(mark, ws_strip(F.col("text"))).alias("quote"), F.col("page").alias("src_page"))


EVIDENCE = r"""evidence AS (SELECT doc_id, pos AS ev, CASE WHEN pos % 3 = 0 THEN '[Page:' || page || '] ' WHEN pos % 3 = 1 THEN '[Page:0] ' ELSE '' END || regexp_replace(text, '^\s+|\s+$', '', 'g') AS quote, page AS src_page FROM elements)"""


def norm_blocks(spark, sf_dir) -> DataFrame:
    e = elements(spark, sf_dir)
    return e.select("doc_id", F.col("pos").alias("block"), "page", normalize_ws(F.col("text")).alias("norm_text"))


NORM_BLOCKS = r"""norm_blocks AS (SELECT doc_id, pos AS block, page, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS norm_text FROM elements)"""


def completions(spark, sf_dir) -> DataFrame:
    """One row per conversation: id, prompt (last user turn), answer (first assistant turn), completion in eight forms by turns.

    0: summary and the prompt's sentences as quotes, with those of the answer
    between; 1: a summary of one word and the prompt's sentences in quotation
    marks; 2: a summary and a support tag that never closes; 3: no tags; 4:
    summary and the prompt's sentences; 5: an empty support section; 6: a
    summary only, its tag in capitals; 7: short quotes only.
    """
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    user = F.filter("turns", lambda t: t["role"] == "user")
    answer = F.filter("turns", lambda t: t["role"] == "assistant")
    c = c.select("conv_id", "turns", F.try_element_at(user, F.lit(-1))["text"].alias("prompt"), F.try_element_at(answer, F.lit(1))["text"].alias("answer"))
    a, p = F.coalesce("answer", F.lit("")), F.coalesce("prompt", F.lit(""))
    lines = lambda x: F.regexp_replace(x, r"([.!?])\s+", "$1\n")
    summary, support = (lambda x: F.concat(F.lit("<summary>"), x, F.lit("</summary>"))), (lambda *x: F.concat(F.lit("<verbatim_support>"), *x, F.lit("</verbatim_support>")))
    quoted = F.concat(F.lit('"'), F.replace(lines(p), F.lit("\n"), F.lit('"\n"')), F.lit('"'))
    forms = (
        F.concat(summary(a), support(lines(p), F.lit("\n"), lines(a))), F.concat(summary(F.lit("Done")), support(quoted)), F.concat(summary(a), F.lit("<verbatim_support>"), a), a,
        F.concat(summary(a), support(lines(p))), F.concat(summary(a), support(F.lit(" "))), F.concat(F.lit("<SUMMARY>"), a, F.lit("</SUMMARY>")), F.concat(summary(a), support(F.lit("a\nb\nc d e"))),
    )
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(F.col("conv_id") % 8 == i, form).otherwise(text)
    return c.withColumn("completion", text)


_LINES = r"regexp_replace(coalesce({0}, ''), '([.!?])\s+', '\1' || chr(10), 'g')"
COMPLETIONS = (
    r"""turns AS (SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'user') AS prompt, min_by(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations GROUP BY conv_id),
completions AS (SELECT conv_id, prompt, answer, CASE conv_id % 8
  WHEN 0 THEN '<summary>' || coalesce(answer, '') || '</summary><verbatim_support>' || PLINES || chr(10) || ALINES || '</verbatim_support>'
  WHEN 1 THEN '<summary>Done</summary><verbatim_support>"' || replace(PLINES, chr(10), '"' || chr(10) || '"') || '"</verbatim_support>'
  WHEN 2 THEN '<summary>' || coalesce(answer, '') || '</summary><verbatim_support>' || coalesce(answer, '')
  WHEN 4 THEN '<summary>' || coalesce(answer, '') || '</summary><verbatim_support>' || PLINES || '</verbatim_support>'
  WHEN 5 THEN '<summary>' || coalesce(answer, '') || '</summary><verbatim_support> </verbatim_support>'
  WHEN 6 THEN '<SUMMARY>' || coalesce(answer, '') || '</SUMMARY>'
  WHEN 7 THEN '<summary>' || coalesce(answer, '') || '</summary><verbatim_support>a' || chr(10) || 'b' || chr(10) || 'c d e</verbatim_support>'
  ELSE coalesce(answer, '') END AS completion FROM turns)"""
).replace("PLINES", _LINES.format("prompt")).replace("ALINES", _LINES.format("answer"))


def labelled(spark, sf_dir) -> DataFrame:
    """Truth and two predictions from labels."""
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("truth"), F.col("toxic").cast("long").alias("pred"))
