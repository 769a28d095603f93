"""Personal data by weak supervision, in native expressions.

Base kinds (email, ip, card, phone) are fixed patterns with fixed checks; their
spans always stay.  Candidates of further kinds are found by one scan of looser
patterns, and four labelers vote on each (1 for, -1 against, 0 abstains):

  shape      the kind's strict form
  gazetteer  known given names, country codes, street words, card issuers
  context    a cue word of the kind shortly before
  counter    a mark of other numbers or words (order, version, #) just before

Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability and each kind's rate (two classes, votes independent
given the class).  The posteriors then train the span classifier, naive Bayes
over the votes and the span's surroundings.  Candidates it accepts that touch
no base span are added.

The pattern counts are bounded (kinds x 3^4 votes x 2^3 features), whatever the
corpus' size; both fits are array expressions over them, and what comes to the
driver is the list of accepted patterns.  Everything else stays per row, with
no shuffle of texts.

Defined cases: a null text is empty; repeated rows keep their rows and count
each in the fit; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .spans import digits, find_spans, let, luhn, nothing

_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind as listed, then start."""
    small = lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.expr("0") + F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    count = lambda v, lo, hi: F.length(digits(v)).between(lo, hi)
    return F.concat(
        find_spans(text, EMAIL, "email", if_text=text.contains("@")),
        find_spans(text, IP, "ip", small, if_text=text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
        find_spans(text, CARD, "card", lambda v: F.when(count(v, 13, 19), luhn(v)).otherwise(F.lit(False)), if_text=text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        find_spans(text, PHONE, "phone", lambda v: count(v, 9, 15), if_text=text.contains("+")),
    )


#: Given names: the hundred most frequent of a century in the United States Social Security
#: Administration's public list (fixed values).
NAMES = tuple(
    """James Michael Robert John David William Richard Joseph Thomas Christopher Charles Daniel Matthew Anthony Mark
    Steven Donald Andrew Joshua Paul Kenneth Kevin Brian Timothy Ronald Jason George Edward Jeffrey Ryan Jacob Nicholas
    Gary Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Frank Raymond Jack
    Dennis Jerry Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Sarah Lisa Nancy Sandra Ashley Emily
    Kimberly Betty Margaret Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Laura Cynthia Amy
    Kathleen Angela Dorothy Shirley Emma Brenda Nicole Pamela Samantha Anna Katherine Christine Debra Rachel Olivia
    Carolyn Maria Janet Heather Diane""".split()
)
#: Country codes that open an account number, of the public IBAN registry (fixed values).
COUNTRIES = tuple(
    """AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO
    KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG
    XK""".split()
)
#: Street words of the United States Postal Service's public list of suffixes (its most frequent ones, fixed values).
STREETS = "Street Avenue Road Lane Drive Boulevard Court Place Way Circle Terrace Parkway Square Trail Highway".split()
#: Leading digits of payment cards (public issuer ranges, fixed values).
ISSUERS = ("4", "5[1-5]", "2[2-7]", "3[4-8]", "6011", "64[4-9]", "65")
CONTEXT = 48

_B, _E = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: kind, loose pattern, strict form, words that point to it
EXTRA = (
    ("name", rf"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{{1,20}}(?:\x20[A-Z][a-z]{{1,20}})?|(?:{'|'.join(NAMES)})\x20[A-Z][a-z]{{1,20}}", r"^\S+\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?$", "name|contact|author|dear|by|signed|regards"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", "ssn|social|security|tax"),
    ("number", r"[0-9](?:[\x20-]?[0-9]){12,18}", r"^(?:[0-9]{13,19}|(?:[0-9]{4}[\x20-]){3}[0-9]{1,7})$", "card|credit|debit|visa|account|payment|konto|carte|tarjeta"),
    ("account", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}", rf"^(?:{'|'.join(COUNTRIES)})", "iban|account|bank|konto|compte|cuenta"),
    ("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"^\(?[2-9]", "call|phone|tel|fax|mobile|cell|contact"),
    ("street", rf"[0-9]{{1,5}}\x20[A-Z][a-z]{{1,20}}\x20(?:{'|'.join(STREETS)})", r"^[1-9]", "address|live|lives|street|home|located|visit"),
)
KINDS = BASE_KINDS + tuple(k for k, *_ in EXTRA)
_LOOSE = _B + "(?=[A-Z0-9(])(?:" + "|".join(p for _, p, _, _ in EXTRA) + ")" + _E
_COUNTER = r"(?i)(?:order|version|invoice|isbn|issue|page|no\.|#|\$|v)\s*$"


def candidates(text: Column) -> Column:
    """array<struct<kind:int,start,end,votes:array<int>,features:array<int>>> of the looser patterns."""
    rank = lambda v: F.coalesce(*[F.when(v.rlike("^(?:" + p + ")$"), F.lit(i)) for i, (_, p, _, _) in enumerate(EXTRA)], F.lit(0)).cast("string")

    def judge(s: Column) -> Column:
        k, v = s["kind"].cast("int"), s["value"]
        before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
        after = F.substring(text, s["end"] + 1, F.lit(1))
        by_kind = lambda f: F.coalesce(*[F.when(k == i, f(*x)) for i, x in enumerate(EXTRA)])
        shape = F.when(by_kind(lambda _k, _p, strict, _c: v.rlike(strict)), 1).otherwise(-1)
        known = by_kind(
            lambda kind, *_: F.when(v.rlike(rf"(?:^|\x20)(?:{'|'.join(NAMES)})(?:\x20|$)"), 1).otherwise(0) if kind == "name"
            else F.when(v.rlike(rf"^(?:{'|'.join(COUNTRIES)})"), 1).otherwise(-1) if kind == "account"
            else F.when(v.rlike(rf"^(?:{'|'.join(ISSUERS)})"), 1).otherwise(0) if kind == "number"
            else F.when(v.rlike(rf"(?:{'|'.join(STREETS)})$"), 1).otherwise(0) if kind == "street" else F.lit(0)
        )
        cue = F.when(by_kind(lambda _k, _p, _s, cues: before.rlike(rf"(?i)\b(?:{cues})\b")), 1).otherwise(0)
        counter = F.when(before.rlike(_COUNTER), -1).otherwise(0)
        features = (before.rlike(r"(?:^|[\s(,;:])$") | (before == ""), after.rlike(r"^[\s,.;:)!?]?$"), before.rlike(r"[:=]\s*$"))
        return F.struct(
            k.alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.array(shape, known, cue, counter).cast("array<int>").alias("votes"), F.array(*[f.cast("int") for f in features]).alias("features"),
        )

    return F.transform(find_spans(text, _LOOSE, rank), judge)


#: Expectation-maximisation over patterns p = (kind, votes, features, n): state s has the
#: rate of each kind and, for votes j and values c (-1, 0, 1), s.a[j][c] = P(c | personal), s.b likewise for not.
_SUM = "aggregate(zip_with(patterns, {q}, (x, y) -> struct(x, y)), 0D, (acc, z) -> acc + IF({when}, z.x.n * ({w}), 0D))"


def _vote_tables(q: str, weight: str) -> str:
    total = _SUM.format(q=q, when="true", w=weight)
    cell = _SUM.format(q=q, when="z.x.votes[j] = c", w=weight)
    return f"transform(sequence(0, 3), j -> transform(sequence(-1, 1), c -> ({cell} + 1D) / ({total} + 3D)))"


def _posterior(s: str) -> str:
    one = f"{s}.pi[x.kind] * aggregate(sequence(0, 3), 1D, (acc, j) -> acc * {s}.a[j][x.votes[j] + 1])"
    none = f"(1D - {s}.pi[x.kind]) * aggregate(sequence(0, 3), 1D, (acc, j) -> acc * {s}.b[j][x.votes[j] + 1])"
    return f"transform(patterns, x -> ({one}) / (({one}) + ({none})))"


def fit(patterns: DataFrame, rounds: int = 20) -> DataFrame:
    """One row: patterns, posterior (by EM) and accepted (by the classifier), in step.

    patterns: kind, votes, features, n.  All sums run over the sorted array, so
    the fit doesn't depend on how the rows were dealt.
    """
    kinds = len(EXTRA)
    rate = _SUM.format(q="q", when="z.x.kind = k", w="z.y")
    seen = _SUM.format(q="q", when="z.x.kind = k", w="1D")
    step = (
        f"transform(array({_posterior('s')}), q -> named_struct("
        f"'pi', transform(sequence(0, {kinds - 1}), k -> ({rate} + 1D) / ({seen} + 2D)), "
        f"'a', {_vote_tables('q', 'z.y')}, 'b', {_vote_tables('q', '1D - z.y')}))[0]"
    )
    start = (
        f"named_struct('pi', array_repeat(5e-1D, {kinds}), "
        "'a', array_repeat(array(1e-1D, 4e-1D, 5e-1D), 4), 'b', array_repeat(array(5e-1D, 4e-1D, 1e-1D), 4))"
    )
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("kind", "votes", "features", F.col("n").cast("double").alias("n")))).alias("patterns"))
    fitted = one.selectExpr("patterns", f"aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step}) AS s").selectExpr("patterns", "s", f"{_posterior('s')} AS posterior")

    # Naive Bayes over kind, votes and features, its labels the posteriors.
    def table(weight: str) -> str:
        total = _SUM.format(q="posterior", when="true", w=weight)
        bits = _SUM.format(q="posterior", when="z.x.features[j] = 1", w=weight)
        kind = _SUM.format(q="posterior", when="z.x.kind = k", w=weight)
        return (
            f"named_struct('kind', transform(sequence(0, {kinds - 1}), k -> ({kind} + 1D) / ({total} + {kinds}D)), "
            f"'votes', {_vote_tables('posterior', weight)}, 'bits', transform(sequence(0, 2), j -> ({bits} + 1D) / ({total} + 2D)), 'all', {total} + 1D)"
        )

    def score(t: str) -> str:
        votes = f"aggregate(sequence(0, 3), 0D, (acc, j) -> acc + ln({t}.votes[j][x.votes[j] + 1]))"
        bits = f"aggregate(sequence(0, 2), 0D, (acc, j) -> acc + ln(IF(x.features[j] = 1, {t}.bits[j], 1D - {t}.bits[j])))"
        return f"(ln({t}.all) + ln({t}.kind[x.kind]) + {votes} + {bits})"

    trained = fitted.selectExpr("patterns", "posterior", f"{table('z.y')} AS yes", f"{table('1D - z.y')} AS no")
    return trained.selectExpr("patterns", "posterior", f"transform(patterns, x -> {score('yes')} > {score('no')}) AS accepted")


def pattern_key(kind: Column, votes: Column, features: Column) -> Column:
    return F.concat_ws("|", kind.cast("string"), F.array_join(votes.cast("array<string>"), ","), F.array_join(features.cast("array<string>"), ","))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (spans of the base kinds), spans (base and accepted ones, by kind, then start)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    found = rows.select("id", F.transform(base_spans(F.col("text")), lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("base"), candidates(F.col("text")).alias("candidates"))
    found = materialize(found, "pii-candidates")
    one = F.col("c")
    counts = found.filter("size(candidates) > 0").select(F.explode("candidates").alias("c")).groupBy(one["kind"].alias("kind"), one["votes"].alias("votes"), one["features"].alias("features")).agg(F.count("*").alias("n"))
    model = fit(counts).select(F.explode(F.arrays_zip("patterns", "accepted")).alias("p")).filter("p.accepted")
    good = [r[0] for r in model.select(pattern_key(F.col("p.patterns.kind"), F.col("p.patterns.votes"), F.col("p.patterns.features"))).collect()]
    names = F.array(*[F.lit(k) for k, *_ in EXTRA])
    accepted = F.array(*[F.lit(g) for g in sorted(good)]) if good else F.array().cast("array<string>")

    def free(base: Column) -> Column:
        fine = F.filter("candidates", lambda c: F.array_contains(accepted, pattern_key(c["kind"], c["votes"], c["features"])) & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        sorted_ = F.array_sort(F.transform(fine, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
        return F.transform(sorted_, lambda c: F.struct(names[c["kind"]].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    return found.select(F.col("id").alias(id_col), "base", F.concat("base", free(F.col("base"))).alias("spans"))


__all__ = ["BASE_KINDS", "KINDS", "base_spans", "candidates", "find_personal", "fit", "let", "nothing"]
