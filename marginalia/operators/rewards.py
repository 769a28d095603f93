"""Scores of generated summaries as Column expressions.

Vectors and entailment probabilities come from injected models (see models);
scores here take their similarity matrices as array columns, one row for each
snippet or claim.  Counts below two get the small constant EPS added in ratios;
larger ones don't (doubles).  A completion without text, or without the
sections a score needs, has that score's stated value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import section, snippet_lines, split_sentences, word_count

EPS = 0.0009765625  # 2 ** -10, fixed
SUMMARY, SUPPORT = "summary", "verbatim_support"
#: weight of each score in the combined reward (fixed values)
WEIGHTS = {"format": 4.0, "fidelity": 3.0, "support_nli": 6.0, "support_semantic": 5.0, "relevance": 2.0, "reference": 5.0, "conciseness": 1.5, "coherence": 1.0}


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def per_count(x: Column, n: Column) -> Column:
    return x / F.when(n < 2, n + EPS).otherwise(n)


def lacks(c: Column) -> Column:
    """Null or empty."""
    return c.isNull() | (c == "")


def format_score(completion: Column) -> Column:
    a, b = section(completion, SUMMARY), section(completion, SUPPORT)
    n = lambda c: word_count(c) >= 3
    both = F.when(n(a) & n(b), 2.0).when(n(a) | n(b), -8.0).otherwise(-10.0)
    return F.when(a.isNotNull() & b.isNotNull(), both).when(a.isNotNull() | b.isNotNull(), -6.0).otherwise(-10.0)


def fidelity_score(completion: Column, source: Column, strict: bool = True) -> Column:
    """Lines quoted word for word; a support tag that is opened counts even if it never closes or holds nothing."""
    support = section(completion, SUPPORT)
    lines = snippet_lines(support, 10, unquote=True)
    total = F.size(lines)
    good = F.size(F.filter(lines, lambda s: source.contains(s)))
    mixed = F.lit(-5.0) if strict else per_count(good * 10.0, total) - 5.0
    empty = F.when(completion.rlike(f"(?i)<{SUPPORT}>"), -6.0).otherwise(-8.0)
    return F.when(lacks(completion) | lacks(source), -8.0).when(lacks(support), empty).when(total == 0, -6.0).when(good == 0, -5.0).when(good == total, 5.0).otherwise(mixed)


def conciseness_score(completion: Column, source: Column) -> Column:
    summary = section(completion, SUMMARY)
    n, m = word_count(source), word_count(summary)
    ideal = F.when(n > 1000, 0.10).when(n > 500, 0.15).otherwise(0.20)
    ratio = per_count(m.cast("double"), n)
    dev = ratio - ideal
    base = F.exp(-0.5 * F.pow(dev / (ideal * 0.5), F.lit(2.0))) * 1.5
    over = F.when(ratio > 1.8 * ideal, (ratio / (1.8 * ideal) - 1.0) * 4.0).otherwise(0.0)
    return F.when(lacks(completion) | lacks(source) | lacks(summary), -8.0).when(n == 0, -1.0).otherwise(clip(base - over, -3.0, 1.5))


def _max_stats(sims: Column, threshold: float) -> tuple[Column, Column]:
    """Mean of each row's largest similarity and the share under threshold; sims is array<array<double>>."""
    best = F.transform(sims, lambda r: F.array_max(r))
    n = F.size(best)
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / n
    return mean, per_count(F.size(F.filter(best, lambda x: x < threshold)).cast("double"), n)


def _no_pairs(sims: Column) -> Column:
    """No row, or rows without a counterpart."""
    return sims.isNull() | (F.size(sims) == 0) | (F.size(F.get(sims, F.lit(0))) == 0)


def _with_sections(completion: Column | None, without_text: float, without_section: float, score: Column) -> Column:
    if completion is None:
        return score
    return F.when(lacks(completion), without_text).when(lacks(section(completion, SUPPORT)) | lacks(section(completion, SUMMARY)), without_section).otherwise(score)


def relevance_score(sims: Column, completion: Column | None = None) -> Column:
    """sims: a row for each snippet, over the summary's sentences."""
    mean, low = _max_stats(sims, 0.55)
    return _with_sections(completion, -10.0, -4.0, F.when(_no_pairs(sims), -3.0).otherwise(clip(5.0 * mean - 3.0 * low, -3.0, 5.0)))


def support_score(sims: Column, scale: float = 4.0, threshold: float = 0.65, completion: Column | None = None) -> Column:
    """sims: a row for each claim, over the snippets; with scale 5 and threshold 0.7 over entailment probabilities."""
    mean, low = _max_stats(sims, threshold)
    return _with_sections(completion, -8.0, -8.0, F.when(_no_pairs(sims), -6.0).otherwise(clip(scale * mean - scale * low, -scale, scale)))


def reference_score(semantic: Column, rouge: Column, completion: Column | None = None, answer: Column | None = None) -> Column:
    """Likeness to a reference summary; without one 0, without a summary to compare -10."""
    mix = 0.6 * clip(semantic, 0.0, 1.0) + 0.4 * clip(rouge, 0.0, 1.0)
    score = clip(15.0 * F.pow(mix, F.lit(1.5)) - 5.0, -5.0, 10.0)
    if completion is None:
        return F.when(semantic.isNull(), 0.0).otherwise(score)
    return F.when(lacks(completion), -10.0).when(lacks(answer), 0.0).when(lacks(section(completion, SUMMARY)), -10.0).otherwise(score)


def coherence_score(consecutive: Column, completion: Column | None = None) -> Column:
    """From the cosines of consecutive sentences; one sentence scores 0."""
    n = F.size(consecutive)
    mean = F.aggregate(consecutive, F.lit(0.0), lambda a, x: a + x) / n
    score = F.when(n == 0, 0.0).otherwise(clip(2.0 * F.exp(-0.5 * F.pow((mean - 0.55) / 0.15, F.lit(2.0))) - 1.0, -1.0, 1.0))
    return score if completion is None else F.when(lacks(completion) | lacks(section(completion, SUMMARY)), -8.0).otherwise(score)


def combined(scores: dict[str, Column], bound: float = 200.0) -> Column:
    total = F.lit(0.0)
    for name, c in scores.items():
        total = total + WEIGHTS[name] * c
    return clip(total, -bound, bound)


def matrix(a: Column, b: Column, alike: Callable[[Column, Column], Column]) -> Column:
    """alike of every member of a with every member of b."""
    return F.transform(a, lambda x: F.transform(b, lambda y: alike(x, y)))


def score_completions(
    df: DataFrame, embed: Callable[[Column], Column], entail: Callable[[Column, Column], Column] | None = None, rouge: Callable[[Column, Column], Column] | None = None,
    sentences: Callable[[Column], Column] = split_sentences, prompt: str = "prompt", completion: str = "completion", answer: str = "answer",
) -> DataFrame:
    """df with the seven scores and their weighted sum, reward.

    embed: array of texts -> array of vectors.  entail: (snippets, claims) -> a
    row of probabilities for each claim; without it support is semantic.  rouge:
    (reference, summary) -> F1.  All three may wrap injected models.
    """
    from ..functions.text import cosine
    from .folds import rouge_l_udf

    c, p, a = F.col(completion), F.col(prompt), F.col(answer)
    support, summary = F.coalesce(section(c, SUPPORT), F.lit("")), F.coalesce(section(c, SUMMARY), F.lit(""))
    # Names of our own columns, which no column of df begins with.
    own = "__"
    while any(x.lower().startswith(own) for x in df.columns):
        own = "_" + own
    at = lambda n: F.col(own + n)
    add = lambda d, cols: d.withColumns({own + n: v for n, v in cols.items()})
    parts = add(df, {"snips": snippet_lines(support, 10), "claims": sentences(summary), "pair": F.array(summary, F.coalesce(a, F.lit("")))})
    vecs = add(parts, {"s": embed(at("snips")), "c": embed(at("claims")), "p": embed(at("pair"))})
    s, k = at("s"), at("c")
    nli = entail(at("snips"), at("claims")) if entail else None
    pairs = F.when(F.size(k) > 1, F.zip_with(F.slice(k, 1, F.size(k) - 1), F.slice(k, 2, F.size(k) - 1), cosine)).otherwise(F.array().cast("array<double>"))
    likeness = (rouge or rouge_l_udf)(F.coalesce(a, F.lit("")), summary)
    made = add(vecs, {"rows": matrix(s, k, cosine), "claim_rows": nli if entail else matrix(k, s, cosine), "next": pairs, "sem": cosine(F.get(own + "p", F.lit(0)), F.get(own + "p", F.lit(1))), "rouge": likeness})
    scores = {
        "format": format_score(c), "fidelity": fidelity_score(c, p), "relevance": relevance_score(at("rows"), c),
        ("support_nli" if entail else "support_semantic"): support_score(at("claim_rows"), *((5.0, 0.7) if entail else ()), completion=c),
        "reference": reference_score(at("sem"), at("rouge"), c, a), "conciseness": conciseness_score(c, p), "coherence": coherence_score(at("next"), c),
    }
    out = made.withColumns(scores)
    out = out.withColumn("reward", combined({n: F.col(n) for n in scores}))
    return out.drop(*[x for x in out.columns if x.startswith(own)])


def zip_rows(left: DataFrame, right: DataFrame, key: str, missing: str = "raise") -> DataFrame:
    """Rows of both sides with the same position; lengths must agree.

    With missing="empty" sides of different length give no rows: the reward is
    then 0 for all, which the caller adds.
    """
    n, m = left.count(), right.count()
    if n != m:
        if missing == "raise":
            raise ValueError(f"{n} rows on one side, {m} on the other")
        return left.join(right, key).filter(F.lit(False))
    return left.join(right, key)
