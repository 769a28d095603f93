"""What travels: exchanges and joins of plans whose shuffle or driver traffic grew too fast."""

from pyspark.sql import functions as F

from marginalia.operators import blocks as B
from marginalia.operators.refine import refine_rounds

WORD = "doc_id long, page int, word_no long, text string, x0 double, y0 double, x1 double, y1 double"


def words(spark):
    return spark.createDataFrame([(d, p, i, f"w{i}", 10.0 * i, 0.0, 10.0 * i + 8, 10.0) for d in (1, 2) for p in (0, 1) for i in range(6)], WORD)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_travel_once(spark):
    """words are dealt by page for their regions, and no more for the regions' texts."""
    regions = spark.createDataFrame([(1, 0, 5, 0.0, 0.0, 25.0, 9.0), (1, 0, 3, 20.0, 0.0, 40.0, 9.0), (1, 0, None, 0.0, 0.0, 99.0, 9.0), (2, 1, 7, 0.0, 50.0, 99.0, 60.0)], "doc_id long, page int, r int, x0 double, y0 double, x1 double, y1 double")
    again = words(spark).filter("word_no = 0 and page = 0").withColumn("x0", F.lit(22.0)).withColumn("x1", F.lit(23.0))
    lost = words(spark).filter("word_no = 1 and page = 0").withColumn("word_no", F.lit(None).cast("long"))
    got = B.assign_words(words(spark).unionByName(again).unionByName(lost), regions, ["doc_id", "page"], "word_no", "r")
    rows = {(r.doc_id, r.page, r.word_no, r.x0): r.r for r in got.collect()}
    assert {k: v for k, v in rows.items() if v} == {(1, 0, 0, 0.0): 3, (1, 0, 0, 22.0): 3, (1, 0, 1, 10.0): 5, (1, 0, 2, 20.0): 3, (1, 0, 3, 30.0): 3, (1, 0, 4, 40.0): 3}
    assert len(rows) == 28
    text = plan(B.assemble_text(B.assign_words(words(spark).hint("merge"), regions, ["doc_id", "page"], "word_no", "r"), ["doc_id", "page", "r"]))
    assert text.count("Exchange hashpartitioning") == 2


def test_rounds_stay_off_the_driver(spark, tmp_path):
    """no join of a round broadcasts the answers so far."""
    chunks = spark.createDataFrame([(d, i, f"t{d}{i}") for d in (1, 2) for i in range(3)], "d long, chunk_index int, text string")
    out = refine_rounds(chunks, "d", lambda t, s: {"summary": t, "evidence": [t]}, str(tmp_path / "cache"))
    assert "Broadcast" not in plan(out)
    assert {r.d: r.summary for r in out.collect()} == {1: "t10\nt11\nt12", 2: "t20\nt21\nt22"}


def test_boxes_are_not_sorted_before_they_travel(spark):
    """medians are counted where a page's boxes have come together."""
    text = plan(B.layout_features(words(spark), ["doc_id", "page"], 600.0))
    assert text.count("Exchange") == 1 and text.rindex("Aggregate") < text.index("Exchange")
