"""Queries over cues, intervals, conversations, labels and run logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cues as C
from ..operators import evidence as E
from ..operators import layout as Y
from ..operators import models as M
from ..operators import rewards as R
from ..operators import runs as U
from ..operators.folds import rouge_l_udf
from . import inputs as I
from .registry import query

L = lambda *names: [F.col(n).cast("long").alias(n) for n in names]
TIME_SQL = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"


# -- subtitles ---------------------------------------------------------------

_SRT = I.CUES + r""", short AS (SELECT user_id, idx, start_ms % 86400000 AS s, end_ms % 86400000 AS e, text FROM cues),
files AS (SELECT user_id, string_agg(CASE WHEN idx % 11 = 5 THEN 'x' ELSE (idx - (idx % 7 = 6)::INT)::VARCHAR END || chr(10) || """ + TIME_SQL.format("s") + """ || CASE WHEN idx % 13 = 4 THEN ' -> ' ELSE ' --> ' END || """ + TIME_SQL.format("e") + r""" || chr(10) || text || chr(10), chr(10) ORDER BY idx) AS value FROM short GROUP BY user_id)"""


def _files(spark, d):
    c = I.cues(spark, d).withColumns({"s": F.col("start_ms") % 86400000, "e": F.col("end_ms") % 86400000})
    number = F.when(F.col("idx") % 11 == 5, "x").otherwise((F.col("idx") - (F.col("idx") % 7 == 6).cast("int")).cast("string"))
    arrow = F.when(F.col("idx") % 13 == 4, " -> ").otherwise(" --> ")
    block = F.concat(number, F.lit("\n"), T.srt_time(F.col("s")), arrow, T.srt_time(F.col("e")), F.lit("\n"), "text", F.lit("\n"))
    g = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))).alias("b"))
    return g.select("user_id", F.array_join(F.transform("b", lambda x: x["b"]), "\n").alias("value"))


@query(f"""WITH {_SRT}, b AS (SELECT user_id, unnest(regexp_split_to_array(value, '\\n\\s*\\n')) AS block, generate_subscripts(regexp_split_to_array(value, '\\n\\s*\\n'), 1) AS n FROM files),
l AS (SELECT user_id, n, string_split(regexp_replace(block, '^\\s+|\\s+$', '', 'g'), chr(10)) AS l FROM b),
i AS (SELECT user_id, n, try_cast(l[1] AS INT) AS idx, l FROM l WHERE len(l) >= 3 AND try_cast(l[1] AS INT) IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, idx ORDER BY n) AS k FROM i),
p AS (SELECT user_id, idx, regexp_extract(l[2], '^\\s*(\\d\\d:\\d\\d:\\d\\d,\\d\\d\\d)\\s*-->\\s*(\\d\\d:\\d\\d:\\d\\d,\\d\\d\\d)\\s*$', 1) AS s, regexp_extract(l[2], '^\\s*(\\d\\d:\\d\\d:\\d\\d,\\d\\d\\d)\\s*-->\\s*(\\d\\d:\\d\\d:\\d\\d,\\d\\d\\d)\\s*$', 2) AS e, array_to_string(l[3:], chr(10)) AS text FROM f WHERE k = 1)
SELECT user_id, idx::BIGINT AS idx, ((substr(s, 1, 2)::BIGINT * 60 + substr(s, 4, 2)::BIGINT) * 60 + substr(s, 7, 2)::BIGINT) * 1000 + substr(s, 10, 3)::BIGINT AS start_ms,
  ((substr(e, 1, 2)::BIGINT * 60 + substr(e, 4, 2)::BIGINT) * 60 + substr(e, 7, 2)::BIGINT) * 1000 + substr(e, 10, 3)::BIGINT AS end_ms, text, '[' || s || ',' || e || '] ' || text AS stamped FROM p WHERE s <> ''""")
def srt_parse(spark, d):
    return C.parse_srt(_files(spark, d), "user_id").select("user_id", *L("idx", "start_ms", "end_ms"), "text", "stamped")


@query(f"""WITH {I.CUES}, short AS (SELECT user_id, idx, start_ms % 86400000 AS s, end_ms % 86400000 AS e, text FROM cues)
SELECT user_id, string_agg(idx || chr(10) || {TIME_SQL.format('s')} || ' --> ' || {TIME_SQL.format('e')} || chr(10) || text || chr(10), chr(10) ORDER BY idx) AS srt FROM short GROUP BY user_id""")
def srt_format(spark, d):
    c = I.cues(spark, d).withColumns({"start_ms": F.col("start_ms") % 86400000, "end_ms": F.col("end_ms") % 86400000})
    return C.format_srt(c, "user_id")


@query(f"WITH {I.CUES} SELECT event_id, {TIME_SQL.format('(start_ms % 86400000)')} AS shown, start_ms % 86400000 AS ms FROM cues")
def srt_time_ms(spark, d):
    shown = T.srt_time(F.col("start_ms") % 86400000)
    return I.cues(spark, d).select("event_id", shown.alias("shown")).withColumn("ms", T.srt_ms(F.col("shown")))


@query(f"WITH {I.CUES}, x AS (SELECT event_id, {TIME_SQL.format('(start_ms % 86400000)')} AS s, {TIME_SQL.format('(end_ms % 86400000)')} AS e, text FROM cues) SELECT event_id, s AS start_time, e AS end_time, text AS bare FROM x")
def timestamp_prefix(spark, d):
    c = I.cues(spark, d)
    stamped = F.concat(F.lit(" [ "), T.srt_time(F.col("start_ms") % 86400000), F.lit(" ,"), T.srt_time(F.col("end_ms") % 86400000), F.lit("] "), "text")
    c = c.select("event_id", stamped.alias("t"))
    return c.select("event_id", T.stamp(F.col("t"), 1).alias("start_time"), T.stamp(F.col("t"), 2).alias("end_time"), T.strip_stamp(F.col("t")).alias("bare"))


@query(f"""WITH {I.CUES} SELECT event_id, regexp_matches(text, '(?i)chapter\\s+(?:(?:one|two|three)\\b|[0-9]+\\b)') AS is_chapter FROM cues""")
def chapter_marker(spark, d):
    return I.cues(spark, d).select("event_id", T.is_chapter(F.col("text")).alias("is_chapter"))


@query(f"""WITH {I.CUES}, m AS (SELECT *, sum((text LIKE 'Chapter %' AND idx > 0)::INT) OVER (PARTITION BY user_id ORDER BY idx) AS chapter FROM cues)
SELECT user_id, chapter::BIGINT AS chapter, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_cues FROM m GROUP BY ALL""")
def chapter_chunks(spark, d):
    return C.chapters(I.cues(spark, d), "user_id").select("user_id", *L("chapter", "first_idx", "last_idx", "n_cues"))


@query(f"""WITH {I.CUES}, v AS (SELECT *, max(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cues WHERE start_ms < end_ms),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ms - before > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS grp FROM v)
SELECT user_id, grp::BIGINT AS grp, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_parts, string_agg(text, ' ' ORDER BY start_ms, event_id) AS text FROM g GROUP BY ALL""")
def merge_intervals(spark, d):
    return C.merge_intervals(I.cues(spark, d), "user_id", "event_id").select("user_id", *L("grp", "start_ms", "end_ms", "n_parts"), "text")


@query(f"WITH {I.CUES} SELECT event_id, 'snippet_' || lpad(idx::VARCHAR, greatest(3, length(idx::VARCHAR))::INT, '0') || '_' || start_ms || '_' || replace(substr(text, 1, 30), ' ', '_') AS file_name FROM cues")
def snippet_filename(spark, d):
    return I.cues(spark, d).select("event_id", T.clip_name(F.col("idx"), F.col("start_ms"), F.col("text")).alias("file_name"))


@query(f"WITH {I.CUES} SELECT event_id FROM cues WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL AND start_ms < end_ms AND text IS NOT NULL")
def interval_sanity(spark, d):
    return C.sane_intervals(I.cues(spark, d)).select("event_id")


@query(f"WITH {I.CUES} SELECT a.user_id, a.idx AS ev, b.idx FROM cues a JOIN cues b ON a.user_id = b.user_id AND (NOT (a.idx - 2 > 0) OR b.idx BETWEEN a.idx - 2 AND a.idx + 2)")
def index_range_candidates(spark, d):
    c = I.cues(spark, d)
    e = c.select("user_id", F.col("idx").alias("ev"), (F.col("idx") - 2).alias("lo"), (F.col("idx") + 2).alias("hi"))
    return E.index_range(e, c.select("user_id", "idx"), "user_id").select("user_id", "ev", "idx")


#: Longest block two texts share: its length and its place in x, the earliest; then in y, the earliest.
_BLOCK = "list_max(flatten(list_transform(range(1, len({x}) + 1), lambda i: list_transform(range(1, len({x}) - i + 2), lambda l: {{'l': CASE WHEN contains({y}, substr({x}, i, l)) THEN l ELSE 0 END, 'i': -i}}))))"
_QUOTE = "CASE idx % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, len(text) - 2) || 'zzz' ELSE substr(text, 3) || ' ' || substr(text, 1, 2) END"


@query(f"""WITH RECURSIVE {I.CUES}, q AS (SELECT user_id, idx AS ev, regexp_replace({_QUOTE}, '^\\s+|\\s+$', '', 'g') AS q FROM cues),
near AS (SELECT q.user_id, ev, q, c.idx, c.start_ms, c.end_ms, c.text FROM q JOIN cues c ON c.user_id = q.user_id AND (NOT (ev - 2 > 0) OR c.idx BETWEEN ev - 2 AND ev + 2)),
work AS (SELECT q AS a, text AS b, q AS x, text AS y, {_BLOCK.format(x='q', y='text')} AS best FROM (SELECT DISTINCT q, text FROM near)
  UNION ALL SELECT a, b, x, y, {_BLOCK.format(x='x', y='y')} FROM (SELECT a, b, unnest([substr(x, 1, i - 1), substr(x, i + l)]) AS x, unnest([substr(y, 1, j - 1), substr(y, j + l)]) AS y
    FROM (SELECT a, b, x, y, best.l AS l, -best.i AS i, strpos(y, substr(x, -best.i, best.l)) AS j FROM work WHERE best.l > 0)) WHERE len(x) > 0 AND len(y) > 0),
scores AS (SELECT a, b, 2 * sum(best.l) / (len(a) + len(b)) AS score FROM work GROUP BY a, b),
ranked AS (SELECT n.*, score, row_number() OVER (PARTITION BY user_id, ev ORDER BY score < 0.95, CASE WHEN score >= 0.95 THEN 0 ELSE -score END, idx) AS k FROM near n JOIN scores ON a = q AND b = text WHERE score >= 0.4)
SELECT user_id, ev, idx, start_ms, end_ms, round(score, 6)::DOUBLE AS score FROM ranked WHERE k = 1""")
def evidence_cue_match(spark, d):
    """Quotes are their cues' texts by turns as they are, with another end, and turned round."""
    c = I.cues(spark, d)
    n = F.length("text")
    turned = F.concat(F.substring("text", F.lit(3), n), F.lit(" "), F.substring("text", 1, 2))
    quote = F.when(F.col("idx") % 3 == 0, F.col("text")).when(F.col("idx") % 3 == 1, F.concat(F.substring("text", F.lit(1), n - 2), F.lit("zzz"))).otherwise(turned)
    stamp = F.concat(F.lit("["), T.srt_time(F.col("start_ms") % 86400000), F.lit(","), T.srt_time(F.col("end_ms") % 86400000), F.lit("] "))
    e = c.select("user_id", F.col("idx").alias("ev"), F.concat(stamp, quote).alias("quote"), (F.col("idx") - 2).alias("lo"), (F.col("idx") + 2).alias("hi"))
    return E.cue_match(e, c, "user_id").select("user_id", *L("ev", "idx", "start_ms", "end_ms"), "score")


@query(f"""WITH RECURSIVE {I.CUES}, seg AS (SELECT user_id, idx, (start_ms - min(start_ms) OVER (PARTITION BY user_id)) / 100000.0::DOUBLE AS s, (end_ms - min(start_ms) OVER (PARTITION BY user_id)) / 100000.0::DOUBLE AS e, text FROM cues),
walk AS (SELECT user_id, idx, s, e, text, CASE WHEN s - 0 < 1.5 AND 1 + length(text) < 120 THEN 1 + length(text) ELSE length(text) END AS held, CASE WHEN s - 0 < 1.5 AND 1 + length(text) < 120 THEN 0 ELSE 1 END AS cue FROM seg WHERE idx = 0
  UNION ALL SELECT n.user_id, n.idx, n.s, n.e, n.text, CASE WHEN n.s - w.e < 1.5 AND w.held + 1 + length(n.text) < 120 THEN w.held + 1 + length(n.text) ELSE length(n.text) END,
    w.cue + CASE WHEN n.s - w.e < 1.5 AND w.held + 1 + length(n.text) < 120 THEN 0 ELSE 1 END FROM walk w JOIN seg n ON n.user_id = w.user_id AND n.idx = w.idx + 1),
packed AS (SELECT user_id, cue, arg_min(s, idx) AS start, arg_max(e, idx) AS "end", string_agg(text, ' ' ORDER BY idx) AS text FROM walk GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY cue) - 1 AS idx, round(start, 5) AS start, round("end", 5) AS "end", text FROM packed""")
def cue_packing(spark, d):
    c = I.cues(spark, d)
    first = F.min("start_ms").over(Window.partitionBy("user_id"))
    s = c.withColumns({"start": (F.col("start_ms") - first) / 100000.0, "end": (F.col("end_ms") - first) / 100000.0})
    return C.pack_cues(s, "user_id", "idx").select("user_id", *L("idx"), F.round("start", 5).alias("start"), F.round("end", 5).alias("end"), "text")


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS text, generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS k FROM documents),
e AS (SELECT *, regexp_matches(text, '[.!?,;:]$')::INT AS ended FROM w), b AS (SELECT *, lag(ended, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM e),
s AS (SELECT *, sum(before) OVER (PARTITION BY doc_id ORDER BY k) AS sent FROM b)
SELECT doc_id, sent::BIGINT AS sent, string_agg(text, ' ' ORDER BY k) AS sentence FROM s GROUP BY ALL""")
def sentence_close(spark, d):
    w = I.table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("k", "text"))
    return C.close_sentences(w, "doc_id", "k").select("doc_id", *L("sent"), "sentence")


@query(f"WITH {I.CUES} SELECT event_id, (start_ms % 86400000) // 3600000 AS h, (start_ms // 60000) % 60 AS m, (start_ms // 1000) % 60 AS s FROM cues")
def seconds_parts(spark, d):
    h, m, s = T.time_parts(F.col("start_ms") % 86400000)
    return I.cues(spark, d).select("event_id", h.alias("h"), m.alias("m"), s.alias("s"))


# -- scalars -----------------------------------------------------------------


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS norm_text FROM documents")
def normalize_text(spark, d):
    return I.table(spark, d, "documents").select("doc_id", T.normalize_ws(F.col("text")).alias("norm_text"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_words, len(string_split(text, ' '))::BIGINT AS n_parts FROM documents")
def word_counts(spark, d):
    return I.table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"), T.blank_word_count(F.col("text")).alias("n_parts"))


_MARKED = "CASE doc_id % 4 WHEN 0 THEN '[Page:' || doc_id || '] ' || text WHEN 1 THEN '[Page: 12 ] ' || text WHEN 2 THEN ' [Page:5] x' ELSE '[Page:a] ' || text END"


@query(rf"""WITH m AS (SELECT doc_id, {_MARKED} AS t FROM documents) SELECT doc_id, try_cast(nullif(regexp_extract(t, '^\[Page:\s*(\d+)\s*\]', 1), '') AS BIGINT) AS page, regexp_replace(t, '^\[Page:\s*\d+\]\s*', '') AS bare, regexp_replace(t, '\[Page:\s*\d+\]\s*', '', 'g') AS bare_anywhere FROM m""")
def page_annotation(spark, d):
    m = I.table(spark, d, "documents").select("doc_id", F.expr(_MARKED).alias("t"))
    return m.select("doc_id", T.page_annotation(F.col("t")).cast("long").alias("page"), T.strip_page(F.col("t")).alias("bare"), T.strip_page(F.col("t"), True).alias("bare_anywhere"))


@query(r"SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem, regexp_replace(regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1), '[^A-Za-z0-9_-]', '_', 'g') AS safe, length(url) > 20 AS long_name FROM pages")
def safe_names(spark, d):
    p = I.table(spark, d, "pages")
    stem = T.base_name(F.col("url"))
    return p.select("page_id", stem.alias("stem"), T.safe_name(stem).alias("safe"), (F.length("url") > 20).alias("long_name"))


@query("""WITH p AS (SELECT '/in/job' || page_id % 7 || '_' || page_id || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.json' WHEN 2 THEN '.txt' ELSE '.png' END AS path, length(html)::BIGINT AS length FROM pages)
SELECT string_split(regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1), '_')[1] AS "group", count(*) AS n_files, sum(length)::BIGINT AS n_bytes, string_agg(path, ',' ORDER BY path) AS paths FROM p WHERE regexp_matches(path, '\\.(pdf|json|txt)$') GROUP BY ALL""")
def grouped_listing(spark, d):
    from ..sources.files import grouped_listing as listing

    p = I.table(spark, d, "pages").select(F.expr("'/in/job' || page_id % 7 || '_' || page_id || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.json' WHEN 2 THEN '.txt' ELSE '.png' END").alias("path"), F.length("html").cast("long").alias("length"))
    g = listing(p)
    return g.select("group", F.size("files").cast("long").alias("n_files"), F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["length"]).alias("n_bytes"), F.array_join(F.transform("files", lambda f: f["path"]), ",").alias("paths"))


_ONES = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
_TENS = "['twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"


def _cap(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


def _three(x: str) -> str:
    """Words of 1 to 999."""
    tail = f"CASE WHEN {x} % 10 > 0 THEN ' ' || {_cap(f'{_ONES}[{x} % 10 + 1]')} ELSE '' END"
    two = f"CASE WHEN {x} % 100 = 0 THEN NULL WHEN {x} % 100 < 20 THEN {_cap(f'{_ONES}[{x} % 100 + 1]')} ELSE {_cap(f'{_TENS}[({x} % 100) // 10 - 1]')} || {tail} END"
    return f"concat_ws(' ', CASE WHEN {x} > 99 THEN {_cap(f'{_ONES}[{x} // 100 + 1]')} || ' Hundred' END, {two})"


_GROUPS = ", ".join(f"CASE WHEN {g} > 0 THEN {_three(g)} || '{name}' END" for g, name in (("b", " Billion"), ("m", " Million"), ("t", " Thousand"), ("u", "")))


@query(f"""WITH n AS (SELECT doc_id, doc_id * 100003 + doc_id % 7 AS n FROM documents), g AS (SELECT *, n // 1000000000 AS b, n // 1000000 % 1000 AS m, n // 1000 % 1000 AS t, n % 1000 AS u FROM n)
SELECT doc_id, n AS num, n::BIGINT AS value, CASE WHEN n = 0 THEN 'Zero' ELSE concat_ws(' ', {_GROUPS}) END AS words FROM g""")
def int2text(spark, d):
    n = I.table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 100003 + F.col("doc_id") % 7).alias("num"))
    w = T.words_of_number(F.col("num"))
    return n.select("doc_id", "num", w.alias("words"), T.number_of_words(F.lower(w)).alias("value"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE (doc_id % 9 + 1) * 1000 + (doc_id % 8 + 1) * 100 + 20 + doc_id % 9 END::BIGINT AS value FROM documents")
def text2int(spark, d):
    ones = F.array(*[F.lit(x) for x in T.UNITS])
    n = F.col("doc_id")
    pick = lambda c: F.get(ones, c.cast("int"))
    phrase = F.concat_ws(" ", pick(n % 9 + 1), F.lit("thousand"), pick(n % 8 + 1), F.lit("hundred"), F.when(n % 5 == 4, "plus").otherwise("and"), F.lit("twenty"), F.when(n % 9 > 0, pick(n % 9)))
    return I.table(spark, d, "documents").select("doc_id", T.number_of_words(phrase).alias("value"))


@query(rf"""WITH {I.COMPLETIONS} SELECT conv_id, CASE WHEN regexp_matches(completion, '(?is)<summary>(.*?)</summary>') THEN regexp_replace(regexp_extract(completion, '(?is)<summary>(.*?)</summary>', 1), '^\s+|\s+$', '', 'g') END AS summary,
  CASE WHEN regexp_matches(completion, '(?is)<verbatim_support>(.*?)</verbatim_support>') THEN regexp_replace(regexp_extract(completion, '(?is)<verbatim_support>(.*?)</verbatim_support>', 1), '^\s+|\s+$', '', 'g') END AS support FROM completions""")
def xml_sections(spark, d):
    c = I.completions(spark, d)
    return c.select("conv_id", T.section(F.col("completion"), R.SUMMARY).alias("summary"), T.section(F.col("completion"), R.SUPPORT).alias("support"))


@query(f"WITH {I.COMPLETIONS} SELECT conv_id, prompt, answer FROM completions")
def chat_role_pick(spark, d):
    c = I.completions(spark, d)
    return c.select("conv_id", T.role_text(F.col("turns"), "user", True).alias("prompt"), T.role_text(F.col("turns"), "assistant", False).alias("answer"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE text END AS answer FROM conversations")
def hash_answer(spark, d):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("work #### "), "text", F.lit(" "))).otherwise(F.col("text"))
    return I.table(spark, d, "conversations").select("conv_id", "turn", T.hash_answer(t).alias("answer"))


@query("SELECT doc_id FROM documents WHERE n_chars <= 3500")
def length_filter(spark, d):
    x = I.table(spark, d, "documents").withColumn("len_text", F.col("n_chars").cast("string"))
    return T.short_enough(x, "len_text", 3500).select("doc_id")


@query("SELECT doc_id FROM documents")
def length_filter_off(spark, d):
    return T.short_enough(I.table(spark, d, "documents"), "n_chars", 0).select("doc_id")


@query("SELECT doc_id, 'user' AS role, 'Summarise the chapter.' || chr(10) || text AS content FROM documents WHERE text IS NOT NULL")
def prompt_format(spark, d):
    m = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Summarise the chapter.\n"), "text").alias("content")))
    return I.table(spark, d, "documents").filter("text is not null").select("doc_id", F.inline(m))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'T' || chr(10) || chr(10) || text ELSE 'T' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Summary so far:' || chr(10) || lang END AS prompt FROM documents")
def prompt_assembly(spark, d):
    running = F.when(F.col("doc_id") % 2 == 1, F.col("lang"))
    return I.table(spark, d, "documents").select("doc_id", M.prompt("T", F.col("text"), running).alias("prompt"))


@query(r"SELECT source, sum(len(string_split(text, ' ')))::BIGINT AS book_words, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS audio_words, CASE WHEN sum(len(string_split(text, ' '))) <= 8192 THEN 'single' ELSE 'chunked' END AS book_mode, CASE WHEN sum(len(regexp_extract_all(text, '\S+'))) <= 8000 THEN 'single' ELSE 'chunked' END AS audio_mode FROM documents GROUP BY source")
def prompt_mode(spark, d):
    g = I.table(spark, d, "documents").groupBy("source").agg(F.sum(T.blank_word_count(F.col("text"))).alias("book_words"), F.sum(T.word_count(F.col("text"))).alias("audio_words"))
    return g.withColumns({"book_mode": M.prompt_mode(F.col("book_words"), 8192), "audio_mode": M.prompt_mode(F.col("audio_words"), 8000)})


@query("""SELECT doc_id, j AS parsed_lang, n AS parsed_chars FROM (SELECT doc_id, lang AS j, n_chars AS n FROM documents)""")
def json_round_trip(spark, d):
    j = F.to_json(F.struct("lang", "n_chars"))
    return I.table(spark, d, "documents").select("doc_id", F.from_json(j, "lang string, n_chars bigint").alias("p")).select("doc_id", F.col("p.lang").alias("parsed_lang"), F.col("p.n_chars").alias("parsed_chars"))


@query("SELECT doc_id, substr(text, 1, 500) AS preview FROM documents")
def truncation(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.substring("text", 1, 500).alias("preview"))


@query("SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def top5_recent(spark, d):
    e = U.latest(I.table(spark, d, "events"), "ts", "event_id", 5)  # the five newest are the feature
    return e.select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query("SELECT doc_id, 'good' AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'poor' FROM labels WHERE quality = 0")
def union_labelled(spark, d):
    x = I.table(spark, d, "labels")
    return x.filter("quality = 1").select("doc_id", F.lit("good").alias("label")).unionByName(x.filter("quality = 0").select("doc_id", F.lit("poor").alias("label")))


@query("""SELECT doc_id, len AS part_no, part AS verbatim_text FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS len, unnest(string_split(text, chr(10))) AS part FROM documents)""")
def cache_evidence_explode(spark, d):
    parts = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("verbatim_text")))
    packed = I.table(spark, d, "documents").select("doc_id", F.to_json(F.struct(parts.alias("evidence"))).alias("j"))
    read = packed.select("doc_id", F.from_json("j", "evidence array<struct<verbatim_text:string>>").alias("c"))
    return read.select("doc_id", F.posexplode("c.evidence").alias("part_no", "e")).select("doc_id", F.col("part_no").cast("long").alias("part_no"), "e.verbatim_text")


@query("SELECT doc_id, quality = 1 OR toxic > 0 AS usable FROM labels")
def cache_validity(spark, d):
    from ..sources.files import cache_usable

    return I.table(spark, d, "labels").select("doc_id", cache_usable(F.when(F.col("quality") == 1, "s"), F.col("toxic")).alias("usable"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_unfinished(spark, d):
    from ..sources.files import unfinished

    return unfinished(I.table(spark, d, "documents").select("doc_id"), I.table(spark, d, "labels"), "doc_id")


# -- vectors and scores ------------------------------------------------------

#: Documents of bounded size: 20 vectors each, in the order of their ids.
_VEC = """WITH v AS (SELECT vec_id, vec_id // 20 AS grp, embedding, lead(embedding) OVER (PARTITION BY vec_id // 20 ORDER BY vec_id) AS nxt FROM embeddings),
c AS (SELECT vec_id, grp, greatest(-1, least(1, list_dot_product(embedding::DOUBLE[], nxt::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(nxt::DOUBLE[], nxt::DOUBLE[]))))) AS cos FROM v WHERE nxt IS NOT NULL)"""


def _vectors(spark, d):
    return I.table(spark, d, "embeddings").withColumn("grp", F.floor(F.col("vec_id") / 20))


def _consecutive(spark, d):
    w = Window.partitionBy("grp").orderBy("vec_id")
    v = _vectors(spark, d).withColumn("nxt", F.lead("embedding").over(w)).filter("nxt is not null")
    return v.select("vec_id", "grp", T.cosine(F.col("embedding"), F.col("nxt")).alias("cos"))


@query(_VEC + " SELECT vec_id, round(cos, 6) AS cosine FROM c")
def cosine_similarity(spark, d):
    return _consecutive(spark, d).select("vec_id", F.round("cos", 6).alias("cosine"))


@query(_VEC + ", m AS (SELECT grp, avg(cos) AS m FROM c GROUP BY grp) SELECT grp, round(greatest(-1, least(1, 2 * exp(-0.5 * pow((m - 0.55) / 0.15, 2)) - 1)), 4) AS score FROM m")
def coherence_score(spark, d):
    g = _consecutive(spark, d).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "cos"))), lambda x: x["cos"]).alias("c"))
    return g.select("grp", F.round(R.coherence_score(F.col("c")), 4).alias("score"))


#: Of each document the even vectors are claims (or snippets) and the odd ones what they are held against.
_SIM = """WITH v AS (SELECT vec_id, vec_id // 20 AS grp, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.grp, a.vec_id, max(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))) AS best FROM v a JOIN v b ON a.grp = b.grp AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY ALL)"""


def _sims(spark, d):
    """Per document of 20 vectors, cosines of all even vectors with all odd ones."""
    v = F.struct("vec_id", "embedding")
    half = lambda odd: F.transform(F.array_sort(F.collect_list(F.when(F.col("vec_id") % 2 == odd, v))), lambda x: x["embedding"])
    g = _vectors(spark, d).groupBy("grp").agg(half(0).alias("a"), half(1).alias("b")).filter("size(a) > 0 and size(b) > 0")
    return g.select("grp", R.matrix(F.col("a"), F.col("b"), T.cosine).alias("sims"))


_LOW = "sum(({b} < {t})::INT) / CASE WHEN count(*) < 2 THEN count(*) + 0.0009765625 ELSE count(*) END"


@query(_SIM + f" SELECT grp, round(greatest(-4, least(4, 4 * avg(best) - 4 * ({_LOW.format(b='best', t=0.65)}))), 4) AS score FROM s GROUP BY grp")
def semantic_support_score(spark, d):
    return _sims(spark, d).select("grp", F.round(R.support_score(F.col("sims")), 4).alias("score"))


@query(_SIM + f" SELECT grp, round(greatest(-5, least(5, 5 * avg((1 + best) / 2) - 5 * ({_LOW.format(b='(1 + best) / 2', t=0.7)}))), 4) AS score FROM s GROUP BY grp")
def entailment_support_score(spark, d):
    """Entailment probabilities, here (1 + cosine) / 2."""
    odds = F.transform("sims", lambda r: F.transform(r, lambda x: (1 + x) / 2))
    return _sims(spark, d).select("grp", F.round(R.support_score(odds, 5.0, 0.7), 4).alias("score"))


@query(_SIM + f" SELECT grp, round(greatest(-3, least(5, 5 * avg(best) - 3 * ({_LOW.format(b='best', t=0.55)}))), 4) AS score FROM s GROUP BY grp")
def relevance_score(spark, d):
    return _sims(spark, d).select("grp", F.round(R.relevance_score(F.col("sims")), 4).alias("score"))


_SEC = I.COMPLETIONS + r""", sec AS (SELECT conv_id, prompt, answer, completion, CASE WHEN regexp_matches(completion, '(?is)<summary>(.*?)</summary>') THEN regexp_replace(regexp_extract(completion, '(?is)<summary>(.*?)</summary>', 1), '^\s+|\s+$', '', 'g') END AS summary,
  CASE WHEN regexp_matches(completion, '(?is)<verbatim_support>(.*?)</verbatim_support>') THEN regexp_replace(regexp_extract(completion, '(?is)<verbatim_support>(.*?)</verbatim_support>', 1), '^\s+|\s+$', '', 'g') END AS support FROM completions),
wr AS (SELECT *, len(regexp_extract_all(summary, '\S+')) AS ns, len(regexp_extract_all(support, '\S+')) AS nv, len(regexp_extract_all(prompt, '\S+')) AS np,
  coalesce(completion, '') = '' AS no_text, coalesce(prompt, '') = '' AS no_prompt, coalesce(summary, '') = '' AS no_summary, coalesce(support, '') = '' AS no_support,
  list_filter(list_transform(string_split(support, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 10) AS snips FROM sec),
wc AS (SELECT *, list_transform(snips, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS lines FROM wr)"""
_FORMAT = "CASE WHEN summary IS NOT NULL AND support IS NOT NULL THEN CASE WHEN ns >= 3 AND nv >= 3 THEN 2 WHEN ns >= 3 OR nv >= 3 THEN -8 ELSE -10 END WHEN summary IS NOT NULL OR support IS NOT NULL THEN -6 ELSE -10 END"
_FIDELITY = "CASE WHEN no_text OR no_prompt THEN -8 WHEN no_support THEN CASE WHEN regexp_matches(completion, '(?i)<verbatim_support>') THEN -6 ELSE -8 END WHEN len(lines) = 0 THEN -6 WHEN len(list_filter(lines, lambda x: contains(prompt, x))) = len(lines) THEN 5 ELSE -5 END"
_IDEAL = "CASE WHEN np > 1000 THEN 0.10 WHEN np > 500 THEN 0.15 ELSE 0.20 END::DOUBLE"
_RATIO = "(ns / (CASE WHEN np < 2 THEN np + 0.0009765625 ELSE np END)::DOUBLE)"
_CONCISE = f"""CASE WHEN no_text OR no_prompt OR no_summary THEN -8 WHEN np = 0 THEN -1 ELSE greatest(-3, least(1.5, exp(-0.5 * pow(({_RATIO} - {_IDEAL}) / ({_IDEAL} * 0.5), 2)) * 1.5
  - CASE WHEN {_RATIO} > 1.8 * {_IDEAL} THEN ({_RATIO} / (1.8 * {_IDEAL}) - 1) * 4 ELSE 0 END)) END"""


@query(f"WITH {_SEC} SELECT conv_id, ({_FORMAT})::DOUBLE AS score FROM wc")
def reward_format(spark, d):
    return I.completions(spark, d).select("conv_id", R.format_score(F.col("completion")).alias("score"))


@query(f"WITH {_SEC} SELECT conv_id, ({_FIDELITY})::DOUBLE AS score FROM wc")
def reward_fidelity(spark, d):
    return I.completions(spark, d).select("conv_id", R.fidelity_score(F.col("completion"), F.col("prompt")).alias("score"))


@query(f"WITH {_SEC} SELECT conv_id, round({_CONCISE}, 4)::DOUBLE AS score FROM wc")
def reward_conciseness(spark, d):
    return I.completions(spark, d).select("conv_id", F.round(R.conciseness_score(F.col("completion"), F.col("prompt")), 4).alias("score"))


#: A stand-in for an embedding model that SQL can express: counts of these letters.
_LETTERS = "etaoinshrdlu"


def _letter_vectors(texts):
    letters = F.array(*[F.lit(x) for x in _LETTERS])
    return F.transform(texts, lambda t: F.transform(letters, lambda x: (F.length(t) - F.length(F.replace(t, x, F.lit("")))).cast("double")))


def _shared_words(a, b):
    """A stand-in for ROUGE: F1 of the distinct words."""
    x, y = (F.array_distinct(T.words(t)) for t in (a, b))
    n = F.size(x) + F.size(y)
    return F.when(n == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / n)


_COUNTS = "list_transform({0}, lambda t: list_transform(" + str(list(_LETTERS)) + ", lambda c: (length(t) - length(replace(t, c, '')))::DOUBLE))"
_COS = "CASE WHEN list_dot_product({0}, {0}) = 0 OR list_dot_product({1}, {1}) = 0 THEN 0 ELSE greatest(-1, least(1, list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))))) END"
_BEST = "list_transform({0}, lambda a: list_max(list_transform({1}, lambda b: " + _COS.format("a", "b") + ")))"
_SCORED = f"""{_SEC}, cl AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(coalesce(summary, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS claims,
  list_distinct(regexp_extract_all(coalesce(answer, ''), '\\S+')) AS wa, list_distinct(regexp_extract_all(coalesce(summary, ''), '\\S+')) AS ws FROM wc),
ve AS (SELECT *, {_COUNTS.format("coalesce(snips, [])")} AS vs, {_COUNTS.format("claims")} AS vc, {_COUNTS.format("[coalesce(summary, ''), coalesce(answer, '')]")} AS vp FROM cl),
be AS (SELECT *, {_BEST.format("vs", "vc")} AS per_snip, {_BEST.format("vc", "vs")} AS per_claim, list_transform(range(1, len(vc)), lambda i: {_COS.format("vc[i]", "vc[i + 1]")}) AS nexts, {_COS.format("vp[1]", "vp[2]")} AS sem,
  CASE WHEN len(wa) + len(ws) = 0 THEN 0 ELSE 2.0 * len(list_intersect(wa, ws)) / (len(wa) + len(ws)) END AS rouge FROM ve),
sc AS (SELECT conv_id, prompt, answer, completion, ({_FORMAT})::DOUBLE AS format, ({_FIDELITY})::DOUBLE AS fidelity, ({_CONCISE})::DOUBLE AS conciseness,
  CASE WHEN no_text THEN -10 WHEN no_support OR no_summary THEN -4 WHEN len(per_snip) = 0 OR len(vc) = 0 THEN -3 ELSE greatest(-3, least(5, 5 * list_avg(per_snip) - 3 * len(list_filter(per_snip, lambda x: x < 0.55)) / CASE WHEN len(per_snip) < 2 THEN len(per_snip) + 0.0009765625 ELSE len(per_snip) END)) END::DOUBLE AS relevance,
  CASE WHEN no_text OR no_support OR no_summary THEN -8 WHEN len(per_claim) = 0 OR len(vs) = 0 THEN -6 ELSE greatest(-4, least(4, 4 * list_avg(per_claim) - 4 * len(list_filter(per_claim, lambda x: x < 0.65)) / CASE WHEN len(per_claim) < 2 THEN len(per_claim) + 0.0009765625 ELSE len(per_claim) END)) END::DOUBLE AS support_semantic,
  CASE WHEN no_text OR no_support OR no_summary THEN -8 WHEN len(per_claim) = 0 OR len(vs) = 0 THEN -6 ELSE greatest(-5, least(5, 5 * list_avg(list_transform(per_claim, lambda x: (1 + x) / 2)) - 5 * len(list_filter(per_claim, lambda x: (1 + x) / 2 < 0.7)) / CASE WHEN len(per_claim) < 2 THEN len(per_claim) + 0.0009765625 ELSE len(per_claim) END)) END::DOUBLE AS support_nli,
  CASE WHEN no_text THEN -10 WHEN coalesce(answer, '') = '' THEN 0 WHEN no_summary THEN -10 ELSE greatest(-5, least(10, 15 * pow(0.6 * greatest(0, least(1, sem)) + 0.4 * greatest(0, least(1, rouge)), 1.5) - 5)) END::DOUBLE AS reference,
  CASE WHEN no_text OR no_summary THEN -8 WHEN len(nexts) = 0 THEN 0 ELSE greatest(-1, least(1, 2 * exp(-0.5 * pow((list_avg(nexts) - 0.55) / 0.15, 2)) - 1)) END::DOUBLE AS coherence FROM be)"""


def _scored(spark, d, nli: bool):
    odds = lambda snips, claims: R.matrix(_letter_vectors(claims), _letter_vectors(snips), lambda x, y: (1 + T.cosine(x, y)) / 2)
    return R.score_completions(I.completions(spark, d), _letter_vectors, odds if nli else None, _shared_words)


@query(f"""WITH {_SCORED} SELECT conv_id, {', '.join(f'round({x}, 3) AS {x}' for x in ('format', 'fidelity', 'relevance', 'support_nli', 'reference', 'conciseness', 'coherence'))},
  round(greatest(-200, least(200, 4 * format + 3 * fidelity + 6 * support_nli + 2 * relevance + 5 * reference + 1.5 * conciseness + 1 * coherence)), 3) AS reward FROM sc""")
def combined_reward(spark, d):
    names = ("format", "fidelity", "relevance", "support_nli", "reference", "conciseness", "coherence", "reward")
    return _scored(spark, d, True).select("conv_id", *[F.round(n, 3).alias(n) for n in names])


@query(f"""WITH {_SCORED} SELECT conv_id, round(support_semantic, 3) AS support_semantic,
  round(greatest(-200, least(200, 4 * format + 3 * fidelity + 5 * support_semantic + 2 * relevance + 5 * reference + 1.5 * conciseness + 1 * coherence)), 3) AS reward FROM sc""")
def combined_reward_semantic(spark, d):
    return _scored(spark, d, False).select("conv_id", *[F.round(n, 3).alias(n) for n in ("support_semantic", "reward")])


@query(f"WITH {_SEC} SELECT conv_id, unnest(lines) AS snippet, contains(prompt, unnest(lines)) AS verbatim FROM wc")
def snippet_fidelity(spark, d):
    c = I.completions(spark, d).select("conv_id", "prompt", F.explode(T.snippet_lines(T.section(F.col("completion"), R.SUPPORT), 10, True)).alias("snippet"))
    return c.select("conv_id", "snippet", F.col("prompt").contains(F.col("snippet")).alias("verbatim"))


@query(f"""WITH RECURSIVE {I.COMPLETIONS}, w AS (SELECT conv_id, regexp_extract_all(lower(prompt), '[a-z0-9]+') AS x, regexp_extract_all(lower(answer), '[a-z0-9]+') AS y FROM completions WHERE prompt IS NOT NULL AND answer IS NOT NULL),
lcs AS (SELECT conv_id, 0 AS i, x, y, list_transform(y, lambda t: 0) AS r FROM w
  UNION ALL SELECT conv_id, i + 1, x, y, list_transform(range(1, len(y) + 1), lambda j: list_max(c[1:j])) FROM (SELECT *, list_transform(range(1, len(y) + 1), lambda j: CASE WHEN x[i + 1] = y[j] THEN coalesce(r[j - 1], 0) + 1 ELSE r[j] END) AS c FROM lcs WHERE i < len(x)))
SELECT conv_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE round(2 * r[-1] / (len(x) + len(y)), 6) END::DOUBLE AS rouge_l FROM lcs WHERE i = len(x)""")
def rouge_l(spark, d):
    c = I.completions(spark, d).filter("prompt is not null and answer is not null")
    return c.select("conv_id", F.round(rouge_l_udf(F.col("prompt"), F.col("answer")), 6).alias("rouge_l"))


@query("SELECT vec_id, round(exp(e[i] - m) / s, 6) AS p, i - 1 AS k FROM (SELECT vec_id, e, m, list_sum(list_transform(e, lambda x: exp(x - m))) AS s, unnest(range(1, len(e) + 1)) AS i FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(embedding::DOUBLE[]) AS m FROM embeddings))")
def softmax_rows(spark, d):
    v = I.table(spark, d, "embeddings").select("vec_id", F.posexplode(T.softmax(F.col("embedding"))).alias("k", "p"))
    return v.select("vec_id", F.col("k").cast("long").alias("k"), F.round("p", 6).alias("p"))


# -- layout learning and metrics ---------------------------------------------

_CM = """WITH x AS (SELECT quality AS truth, toxic AS pred FROM labels), l AS (SELECT truth AS label FROM x UNION SELECT pred FROM x),
m AS (SELECT label, (SELECT count(*) FROM x WHERE truth = label AND pred = label) AS tp, (SELECT count(*) FROM x WHERE truth <> label AND pred = label) AS fp, (SELECT count(*) FROM x WHERE truth = label AND pred <> label) AS fn FROM l),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM m),
r AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p)"""


@query(_CM + " SELECT label::BIGINT AS label, tp, fp, fn, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM r")
def classification_metrics(spark, d):
    m = Y.class_metrics(I.labelled(spark, d), "truth", "pred")
    return m.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_CM + " SELECT round(avg(precision), 6)::DOUBLE AS precision, round(avg(recall), 6)::DOUBLE AS recall, round(avg(f1), 6)::DOUBLE AS f1, (SELECT round(avg((truth = pred)::INT), 6) FROM x)::DOUBLE AS accuracy FROM r")
def classification_macro(spark, d):
    x = I.labelled(spark, d)
    return Y.macro(Y.class_metrics(x, "truth", "pred"), x, "truth", "pred").select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("SELECT quality::BIGINT AS truth, toxic::BIGINT AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark, d):
    return Y.confusion(I.labelled(spark, d), "truth", "pred")


_RUNS = "SELECT event_type AS status, avg(value) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type"


def _status(spark, d):
    return I.table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(f"WITH m AS ({_RUNS}), b AS (SELECT * FROM m WHERE status = 'signup') SELECT m.status, round(m.mean - b.mean, 6) AS mean, round(m.least - b.least, 6) AS least, round(m.most - b.most, 6) AS most FROM m, b")
def metric_diff_vs_baseline(spark, d):
    x = Y.difference_to_baseline(_status(spark, d), "status", "signup", ["mean", "least", "most"])
    return x.select("status", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most")])


@query(f"WITH m AS ({_RUNS}) SELECT status, 'mean' AS metric, round(mean, 6) AS value FROM m UNION ALL SELECT status, 'least', round(least, 6) FROM m UNION ALL SELECT status, 'most', round(most, 6) FROM m")
def metric_unpivot(spark, d):
    return Y.unpivot(_status(spark, d), "status", ["mean", "least", "most"]).withColumn("value", F.round("value", 6))


@query(f"WITH m AS ({_RUNS}) SELECT arg_max(status, (mean, status)) AS best FROM m")
def best_model(spark, d):
    return _status(spark, d).agg(F.max_by("status", F.struct("mean", "status")).alias("best"))


@query("SELECT event_id % 5 AS fold, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def fold_scores(spark, d):
    s = Y.fold_scores(I.table(spark, d, "events"), (F.col("event_id") % 5).alias("fold"), "value")
    return s.select("fold", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT event_type AS label, date_trunc('day', ts)::DATE AS day, count(*) AS n, round(sum(value), 4) AS seconds, count(*) FILTER (WHERE value > 50) AS slow FROM events GROUP BY ALL")
def run_counters(spark, d):
    e = I.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("label"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("seconds"), F.count_if(F.col("value") > 50).alias("slow"))


@query("""SELECT status, method, error_type, grouping_id(status, method, error_type)::BIGINT AS set_id, count(*) AS n, round(sum(seconds), 4) AS seconds
FROM (SELECT event_type AS status, user_id % 3 AS method, CASE WHEN value > 50 THEN 'slow' END AS error_type, value AS seconds FROM events) GROUP BY GROUPING SETS ((status), (method, status), (error_type))""")
def run_counters_sets(spark, d):
    """Counters by status, by method and status, and by error type, in one pass."""
    e = I.table(spark, d, "events").select(F.col("event_type").alias("status"), (F.col("user_id") % 3).alias("method"), F.when(F.col("value") > 50, "slow").alias("error_type"), F.col("value").alias("seconds"))
    out = U.counters_by(e, [("status",), ("method", "status"), ("error_type",)])
    return out.select("status", "method", "error_type", F.col("set_id").cast("long").alias("set_id"), "n", F.round("seconds", 4).alias("seconds"))


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS hits, count(*) FILTER (WHERE l.doc_id IS NULL) AS misses FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def cache_counters(spark, d):
    return U.cache_counters(I.table(spark, d, "documents").select("doc_id"), I.table(spark, d, "labels"), "doc_id")


_LE = ", ".join(f"({b}::DOUBLE)" for b in U.BUCKETS)


@query(f"""WITH b AS (SELECT * FROM (VALUES {_LE}, ('inf'::DOUBLE)) AS t(le)), e AS (SELECT event_type AS label, value / 10 AS seconds FROM events)
SELECT label, le, count(*) FILTER (WHERE seconds <= le) AS n, count(*) AS total, round(sum(seconds), 4) AS sum FROM e, b GROUP BY ALL""")
def run_histogram(spark, d):
    e = I.table(spark, d, "events").select(F.col("event_type").alias("label"), (F.col("value") / 10).alias("seconds"))
    return U.histogram(e, ["label"]).withColumn("sum", F.round("sum", 4))


@query("""WITH m AS (SELECT event_id, ts, CASE WHEN event_type IN ('purchase', 'logout') THEN -1 ELSE 1 END AS change FROM events)
SELECT event_id, sum(change) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS active FROM m""")
def active_gauge(spark, d):
    c = F.when(F.col("event_type").isin("purchase", "logout"), -1).otherwise(1)
    return U.active(I.table(spark, d, "events").select("event_id", "ts", c.alias("change"))).select("event_id", "active")


@query(f"WITH {I.CUES} SELECT event_id, idx, start_ms, end_ms + 100 AS end_ms FROM cues")
def clip_spans(spark, d):
    from ..sources.files import clip_rows

    return clip_rows(I.cues(spark, d), "event_id").select("event_id", *L("idx", "start_ms", "end_ms"))


@query(f"WITH {I.CUES} SELECT event_id FROM cues WHERE idx % 3 <> 0 AND idx % 5 <> 0")
def evidence_valid(spark, d):
    c = I.cues(spark, d).select("event_id", F.when(F.col("idx") % 3 != 0, F.col("start_ms")).alias("start"), F.col("end_ms").alias("end"), F.when(F.col("idx") % 5 != 0, F.col("text")).alias("text"))
    return E.valid_evidence(c).select("event_id")


@query(f"""WITH {I.CUES}, n AS (SELECT user_id, idx // 7 AS chunk_index, count(*) FILTER (WHERE idx % 4 <> 0) AS n, min(idx) AS start_index, max(idx) AS end_index FROM cues GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM n),
e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1 AS i FROM cues WHERE idx % 4 <> 0)
SELECT e.user_id, e.event_id, r.chunk_index, r.start_index, r.end_index FROM e LEFT JOIN r ON r.user_id = e.user_id AND e.i >= r.first AND e.i < r.first + r.n""")
def chunk_ordinal_lookup(spark, d):
    c = I.cues(spark, d).withColumn("chunk_index", F.floor(F.col("idx") / 7))
    n = c.groupBy("user_id", "chunk_index").agg(F.count_if(F.col("idx") % 4 != 0).alias("n"), F.min("idx").alias("start_index"), F.max("idx").alias("end_index"))
    e = c.filter("idx % 4 <> 0").select("user_id", "event_id", "idx")
    return E.chunk_of_ordinal(e, n, "user_id", "idx").select("user_id", "event_id", *L("chunk_index", "start_index", "end_index"))


@query("SELECT count(DISTINCT label) AS n_classes, min(c) AS smallest FROM (SELECT label, count(*) AS c FROM embeddings GROUP BY label)")
def class_guard(spark, d):
    return Y.class_guard(I.table(spark, d, "embeddings"), "label")


@query("SELECT event_id, CASE WHEN status = 'success' THEN 'completed' ELSE 'failed' END AS job FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'success' ELSE event_type END AS status FROM events)")
def job_status(spark, d):
    e = I.table(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "success").otherwise(F.col("event_type")))
    return e.select("event_id", U.job_state(F.col("status")).alias("job"))


@query("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, round((value - m) / s, 4) AS value FROM events, s")
def standard_scale(spark, d):
    return Y.standard_scale(I.table(spark, d, "events").select("event_id", "value"), ["value"]).select("event_id", F.round("value", 4).alias("value"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def label_encode(spark, d):
    return Y.label_encode(I.table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", "code")


@query("SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) THEN 0 ELSE value END::DOUBLE AS value FROM events")
def impute_features(spark, d):
    bad = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 7 == 1, float("inf")).when(F.col("event_id") % 7 == 2, None).otherwise(F.col("value"))
    return Y.impute(I.table(spark, d, "events").select("event_id", bad.alias("value")), ["value"])


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), dist AS (SELECT q.vec_id, p.vec_id AS p, p.label, round(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)), 9) AS dd FROM q, embeddings p),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dd, p) AS n FROM dist), v AS (SELECT vec_id, label, count(*) AS c FROM k WHERE n <= 5 GROUP BY ALL)
SELECT vec_id, arg_max(label, (c, -label))::BIGINT AS predicted FROM v GROUP BY vec_id""")
def knn_predict(spark, d):
    e = I.table(spark, d, "embeddings")
    return Y.knn_predict(e.filter("vec_id % 50 = 0"), e, "vec_id", "vec_id", "embedding", "label")


@query("SELECT label, count(*) AS n, round(count(*) * 0.2)::BIGINT AS n_test FROM embeddings GROUP BY label")
def stratified_split(spark, d):
    e = I.table(spark, d, "embeddings").select("vec_id", "label")
    return Y.stratified_split(e, "label", "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))
