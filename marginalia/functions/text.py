"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words (fixed values).
UNITS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12}

TIME = r"[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}"
STAMP = rf"^\s*\[\s*({TIME})\s*,\s*({TIME})\s*\]\s*"
CHAPTER = r"(?i)chapter\s+(?:(?:" + "|".join(UNITS[1:] + TENS + ["hundred", "thousand"]) + r")\b[\s:.]*|[0-9]+\b[\s:.]*)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an expression inside a lambda is evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ws_strip(c: Column) -> Column:
    """Leading and trailing Unicode white space removed."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def blank_word_count(c: Column) -> Column:
    """Parts between single blanks, empty ones too."""
    return F.size(F.split(c, " ", -1)).cast("long")


def normalize_ws(c: Column) -> Column:
    return F.array_join(words(c), " ")


def page_annotation(c: Column) -> Column:
    """The page of a leading [Page:n], else null."""
    return F.nullif(F.regexp_extract(c, r"^\[Page:\s*(\d+)\s*\]", 1), F.lit("")).try_cast("int")


def strip_page(c: Column, anywhere: bool = False) -> Column:
    return F.regexp_replace(c, ("" if anywhere else "^") + r"\[Page:\s*\d+\]\s*", "")


def stamp(c: Column, which: int) -> Column:
    """Start (1) or end (2) of a leading [start,end], else null."""
    return F.nullif(F.regexp_extract(c, STAMP, which), F.lit(""))


def strip_stamp(c: Column) -> Column:
    return F.regexp_replace(c, STAMP, "")


def srt_ms(c: Column, strict: bool = False) -> Column:
    """HH:MM:SS,mmm in milliseconds; null if malformed, or an error if strict."""
    p = F.split(c, "[:,]")
    n = lambda i: F.get(p, F.lit(i)).try_cast("long")
    ms = F.when(c.rlike(rf"^{TIME}$"), ((n(0) * 60 + n(1)) * 60 + n(2)) * 1000 + n(3))
    return ms if not strict else F.when(c.isNotNull() & ms.isNull(), F.raise_error(F.concat(F.lit("no time: "), c)).cast("long")).otherwise(ms)


def srt_time(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.expr("1") * F.floor(ms / 1000)
    return F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def time_parts(ms: Column) -> tuple[Column, Column, Column]:
    """Hours, minutes and seconds of milliseconds."""
    s = F.floor(ms / 1000)
    return F.floor(s / 3600), F.floor(s / 60) % 60, s % 60


def is_chapter(c: Column) -> Column:
    return c.rlike(CHAPTER)


def section(c: Column, tag: str) -> Column:
    """Stripped text of the first <tag>..</tag>; null without one."""
    found = F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.when(F.size(found) > 0, ws_strip(F.element_at(found, 1)))


def hash_answer(c: Column) -> Column:
    """What stands after ####, stripped, else the whole text."""
    return F.when(c.contains("####"), ws_strip(F.element_at(F.split(c, "####"), 2))).otherwise(c)


def safe_name(c: Column) -> Column:
    """Everything but letters, digits, _ and - becomes _."""
    return F.regexp_replace(c, r"[^\p{Alnum}_-]", "_")


def clip_name(index: Column, start_ms: Column, text: Column) -> Column:
    """snippet_{index}_{start}_{30 characters of text, marks dropped, white space to _}."""
    short = F.regexp_replace(F.regexp_replace(F.substring(text, 1, 30), r'[\\/*?:"<>|,.;]', ""), r"\s+", "_")
    return F.concat(F.lit("snippet_"), F.lpad(index.cast("string"), 3, "0"), F.lit("_"), start_ms.cast("string"), F.lit("_"), short)


def base_name(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def phrases(c: Column, size: int = 8, more_than: int = 10, least_chars: int = 15) -> Column:
    """Sliding phrases of a text of over more_than words."""

    def build(w: Column) -> Column:
        n = F.size(w)
        got = F.transform(F.sequence(F.lit(0), n - (size - 2)), lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))
        return F.when(n > more_than, F.filter(got, lambda p: F.length(p) > least_chars)).otherwise(F.array().cast("array<string>"))

    # bound once: an expression inside a lambda is evaluated for every element
    return F.element_at(F.transform(F.array(words(c)), build), 1)


def snippet_lines(c: Column, least: int = 10, unquote: bool = False) -> Column:
    """Lines of at least `least` characters once stripped; then double and single quotes around them go if asked."""
    lines = F.filter(F.transform(F.split(c, "\n"), ws_strip), lambda x: F.length(x) >= least)
    bare = lambda x, q: F.regexp_replace(x, f"^{q}+|{q}+$", "")
    return F.transform(lines, lambda x: ws_strip(bare(bare(x, '"'), "'"))) if unquote else lines


def split_sentences(c: Column) -> Column:
    """Substitute sentence splitter: after . ! or ? and white space; empty parts go."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), ws_strip), lambda x: F.length(x) > 0)


def number_of_words(c: Column) -> Column:
    """Value of a lower-case number in words; null on an unknown word."""
    values = {w: i for i, w in enumerate(UNITS)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
    lookup = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])
    scale = F.create_map(*[F.lit(x) for k, v in SCALES.items() for x in (k, v)]).cast("map<string,bigint>")
    state = lambda total, now, ok: F.struct(total.cast("long").alias("total"), now.cast("long").alias("now"), ok.alias("ok"))

    def step(s: Column, w: Column) -> Column:
        unit, mult = F.try_element_at(lookup, w), F.try_element_at(scale, w)
        return (
            F.when(unit.isNotNull(), state(s["total"], s["now"] + unit, s["ok"]))
            .when(mult > 100, state(s["total"] + s["now"] * mult, F.lit(0), s["ok"]))
            .when(mult.isNotNull(), state(s["total"], s["now"] * mult, s["ok"]))
            .otherwise(state(s["total"], s["now"], s["ok"] & (w == "and")))
        )

    return F.aggregate(words(c), state(F.lit(0), F.lit(0), F.lit(True)), step, lambda s: F.when(s["ok"], s["total"] + s["now"]))


def words_of_number(n: Column) -> Column:
    """0 to 999999999999 in capitalised words, groups of a thousand named."""
    small, tens = F.array(*[F.lit(w.capitalize()) for w in UNITS]), F.array(*[F.lit(w.capitalize()) for w in ["", ""] + TENS])

    def group(x: Column) -> Column:
        """Words of 1 to 999, blank-joined; empty for 0."""
        h, r = F.floor(x / 100).cast("int"), (x % 100).cast("int")
        two = F.when(r == 0, F.lit(None)).when(r < 20, F.get(small, r)).otherwise(F.concat_ws(" ", F.get(tens, F.floor(r / 10).cast("int")), F.when(r % 10 > 0, F.get(small, r % 10))))
        return F.concat_ws(" ", F.when(h > 0, F.concat(F.get(small, h), F.lit(" Hundred"))), two)

    parts = []
    for power, name in ((9, "Billion"), (6, "Million"), (3, "Thousand"), (0, "")):
        x = F.floor(n / 10**power) % 1000
        parts.append(F.when(x > 0, F.concat_ws(" ", group(x), F.lit(name)) if name else group(x)))
    return F.when(n == 0, F.lit("Zero")).otherwise(F.concat_ws(" ", *parts))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, clipped to [-1, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.least(F.greatest(dot(a, b) / norm, F.lit(-1.0)), F.lit(1.0)))


def softmax(v: Column) -> Column:
    """Exponentials of the entries over their sum, shifted by the largest."""
    top = F.array_max(v).cast("double")
    e = F.transform(v, lambda x: F.exp(x.cast("double") - top))
    return F.element_at(F.transform(F.array(e), lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, y: a + y))), 1)


def short_enough(df, length: str, most: int):
    """Rows whose length, a number or its text, is at most `most`; all rows if most is 0 or less."""
    return df if most <= 0 else df.filter(F.col(length).try_cast("bigint") <= most)


def role_text(turns: Column, role: str, last: bool) -> Column:
    """Text of the first or last turn of a role in array<struct<role,text>>."""
    own = F.filter(turns, lambda t: t["role"] == role)
    return F.try_element_at(own, F.lit(-1 if last else 1))["text"]


def content_text(item: Column, kind: str, role: str = "assistant", last: bool = False) -> Column:
    """Text of a prompt or completion in any of its forms: text, fields (a map: response, text or content), turns."""
    if kind == "text":
        return item
    if kind == "fields":
        return F.coalesce(*[F.try_element_at(item, F.lit(k)) for k in ("response", "text", "content")])
    if kind == "turns":
        return role_text(item, role, last)
    raise ValueError(f"no such form: {kind}")
