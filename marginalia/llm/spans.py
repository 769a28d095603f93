"""Native span extraction: places of regular-expression matches as SQL expressions.

Spark has no function that returns the places of all matches.  Matching
``\\G.*?(pattern)`` instead gives each gap together with its match; the ends are
the running sum of the lengths.  ``\\G`` ties each find to the end of the last,
so the text behind the last match costs one pass.  Offsets are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nothing(kind: str = SPAN) -> Column:
    return F.from_json(F.lit("[]"), kind)


def find_spans(text: Column, pattern: str, kind: str | Callable[[Column], Column], keep: Callable[[Column], Column] | None = None, if_text: Column | None = None) -> Column:
    """Array of (kind, start, end, value): leftmost non-overlapping matches, failing ones dropped.

    if_text: a cheap condition that every text with a match meets.
    """
    whole = r"(?s)\G.*?(" + pattern + ")"

    def build(p: Column) -> Column:
        ends = F.aggregate(p, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))

        def rows(e: Column) -> Column:
            values = F.transform(p, lambda x, i: F.struct(F.regexp_extract(x, whole, 1).alias("value"), e[i + 1].alias("end")))
            made = F.transform(
                values,
                lambda v: F.struct(
                    (F.lit(kind) if isinstance(kind, str) else kind(v["value"])).alias("kind"),
                    (v["end"] - F.length(v["value"])).alias("start"), v["end"].alias("end"), v["value"].alias("value"),
                ),
            )
            return F.filter(made, lambda s: keep(s["value"])) if keep else made

        return let(ends, rows)

    found = let(F.regexp_extract_all(text, F.lit(whole), F.lit(0)), build)
    return F.when(if_text, found).otherwise(nothing()) if if_text is not None else found


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits in value pass the Luhn check."""

    def total(d: Column) -> Column:
        n = F.length(d)
        # place i from the right; every second digit counts double, less 9 if over 9
        parts = F.transform(
            F.sequence(F.lit(1), n),
            lambda i: let(F.substring(d, n - i + 1, F.lit(1)).cast("int"), lambda x: F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))),
        )
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0

    return let(digits(value), total)


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
