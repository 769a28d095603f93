"""Scores worked out by hand from the survey's rules."""

import math

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import rewards as R


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<array<double>>' if k == 'sims' else 'array<double>' if k == 'steps' else 'double' if k in ('sem', 'rouge') else 'string'}" for k in values))
    return rows.select(column.alias("x")).first().x


def tags(summary, support):
    return f"<summary>{summary}</summary><verbatim_support>{support}</verbatim_support>"


@pytest.mark.parametrize(
    "completion,source,strict,want",
    [
        (tags("s", "the first long line\nthe second long line"), "the first long line, the second long line", True, 5.0),
        (tags("s", "the first long line\nsome other long line"), "the first long line", True, -5.0),
        (tags("s", "the first long line\nsome other long line"), "the first long line", False, 0.0),
        # ten characters are counted before the quotation marks go
        (tags("s", '"abcdefgh"'), "x abcdefgh x", True, 5.0),
        (tags("s", "\"'abcdefghij'\""), "x abcdefghij x", True, 5.0),
        (tags("s", "short"), "short", True, -6.0),
        (tags("s", " "), "text", True, -6.0),
        ("<summary>s</summary><verbatim_support>never closed", "text", True, -6.0),
        ("<summary>s</summary>", "text", True, -8.0),
        (tags("s", "the first long line"), "", True, -8.0),
        (tags("s", "the first long line"), None, True, -8.0),
        ("", "text", True, -8.0),
        (None, "text", True, -8.0),
        (tags("s", "a line that is nowhere"), "text", False, -5.0),
    ],
)
def test_fidelity(spark, completion, source, strict, want):
    assert one(spark, R.fidelity_score(F.col("c"), F.col("s"), strict), c=completion, s=source) == pytest.approx(want, abs=0.01)


def test_conciseness(spark):
    score = lambda words, source: one(spark, R.conciseness_score(F.col("c"), F.col("s")), c=f"<summary>{words}</summary>", s=source)
    assert score("w " * 20, "w " * 100) == pytest.approx(1.5)
    assert score("w " * 72, "w " * 100) == -3.0
    # 10 of 100: half the ideal is one sigma off
    assert score("w " * 10, "w " * 100) == pytest.approx(1.5 * math.exp(-0.5))
    assert score("w " * 60, "w " * 600) == pytest.approx(1.5 * math.exp(-0.5 * ((0.1 - 0.15) / 0.075) ** 2))
    assert (score("w", " \n "), score("w", ""), score("", "w w"), score("w", None)) == (-1.0, -8.0, -8.0, -8.0)


def test_relevance_and_support(spark):
    both = tags("One.", "a long enough line")
    sims = [[0.9, 0.1], [0.2, 0.5]]
    # means of the rows' best: 0.7; one of two under 0.55 (and under 0.65)
    assert one(spark, R.relevance_score(F.col("sims"), F.col("c")), sims=sims, c=both) == pytest.approx(5 * 0.7 - 3 * 0.5)
    assert one(spark, R.support_score(F.col("sims"), completion=F.col("c")), sims=sims, c=both) == pytest.approx(4 * 0.7 - 4 * 0.5)
    assert one(spark, R.support_score(F.col("sims"), 5.0, 0.7, F.col("c")), sims=sims, c=both) == pytest.approx(5 * 0.7 - 5 * 0.5)
    # a single row counts as 1 + EPS
    assert one(spark, R.relevance_score(F.col("sims"), F.col("c")), sims=[[0.5]], c=both) == pytest.approx(5 * 0.5 - 3 / (1 + R.EPS))
    for c, sims, relevance, support in (("", sims, -10, -8), (None, sims, -10, -8), ("<summary>x</summary>", sims, -4, -8), (tags("", "x"), sims, -4, -8), (both, [], -3, -6), (both, [[], []], -3, -6)):
        assert one(spark, R.relevance_score(F.col("sims"), F.col("c")), sims=sims, c=c) == relevance
        assert one(spark, R.support_score(F.col("sims"), completion=F.col("c")), sims=sims, c=c) == support


def test_reference(spark):
    score = lambda c, a, sem=0.5, rouge=0.25: one(spark, R.reference_score(F.col("sem"), F.col("rouge"), F.col("c"), F.col("a")), sem=sem, rouge=rouge, c=c, a=a)
    assert score(tags("x", "y"), "ref") == pytest.approx(15 * 0.4**1.5 - 5)
    assert score(tags("x", "y"), "ref", 1.0, 1.0) == 10.0 and score(tags("x", "y"), "ref", -0.5, 0.0) == -5.0
    assert (score(tags("x", "y"), None), score(tags("x", "y"), ""), score("", "ref"), score("no tags", "ref"), score("no tags", None)) == (0.0, 0.0, -10.0, -10.0, 0.0)


def test_coherence(spark):
    score = lambda steps, c: one(spark, R.coherence_score(F.col("steps"), F.col("c")), steps=steps, c=c)
    assert score([0.55, 0.55], tags("x", "y")) == pytest.approx(1.0)
    assert score([0.4], tags("x", "y")) == pytest.approx(2 * math.exp(-0.5) - 1)
    assert (score([], tags("x", "y")), score([], tags("", "y")), score([0.5], "")) == (0.0, -8.0, -8.0)


def test_weights_and_bound(spark):
    w = {"format": 2.0, "fidelity": 5.0, "support_nli": 1.0, "relevance": 1.0, "reference": 1.0, "conciseness": 1.0, "coherence": 1.0}
    total = lambda scores: spark.range(1).select(R.combined({k: F.lit(float(v)) for k, v in scores.items()}).alias("x")).first().x
    assert total(w) == pytest.approx(4 * 2 + 3 * 5 + 6 + 2 + 5 + 1.5 + 1)
    assert total({"support_semantic": 3.0}) == 15.0 and total({"format": -100.0}) == -200.0


def test_whole_completion(spark):
    """Seven scores of one completion with vectors by hand: sentence vectors (1, 0) and (0.6, 0.8), the quote (1, 0)."""
    c = tags("Alpha one two. Beta one two.", "alpha line is quoted")
    rows = spark.createDataFrame([(1, "alpha line is quoted " + "w " * 26, c, "Alpha one two. Beta one two.")], "id long, prompt string, completion string, answer string")
    vector = lambda t: F.when(t.startswith("Beta"), F.array(F.lit(0.6), F.lit(0.8))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    got = R.score_completions(rows, lambda a: F.transform(a, vector)).first()
    assert (got.format, got.fidelity) == (2.0, 5.0)
    assert got.relevance == pytest.approx(5.0)
    assert got.support_semantic == pytest.approx(4 * (1 + 0.6) / 2 - 4 * 0.5)
    assert got.reference == 10.0
    assert got.conciseness == pytest.approx(1.5)
    assert got.coherence == pytest.approx(2 * math.exp(-0.5 * (0.05 / 0.15) ** 2) - 1)
    assert got.reward == pytest.approx(8 + 15 + 5 * 1.2 + 2 * 5 + 5 * 10 + 1.5 * 1.5 + got.coherence)


def test_rows_of_different_number(spark):
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(2).withColumn("y", F.lit(2))
    with pytest.raises(ValueError):
        R.zip_rows(a, b, "id")
    assert R.zip_rows(a, b, "id", missing="empty").count() == 0 and R.zip_rows(a, a.withColumnRenamed("x", "y"), "id").count() == 3


def test_forms_of_content(spark):
    df = spark.sql("select 'a' as t, map('text', 'b', 'content', 'c') as f, array(named_struct('role','user','text','d'), named_struct('role','assistant','text','e')) as r")
    got = df.select(T.content_text(F.col("t"), "text").alias("a"), T.content_text(F.col("f"), "fields").alias("b"), T.content_text(F.col("r"), "turns", "user", True).alias("c")).first()
    assert tuple(got) == ("a", "b", "d")
