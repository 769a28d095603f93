"""Worked cases of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.config import EngineConfig, SourceError, ValidationError
from marginalia.functions import text as T
from marginalia.operators import blocks as B
from marginalia.operators import cues as C
from marginalia.operators import evidence as E
from marginalia.operators import folds
from marginalia.operators import hierarchy as H
from marginalia.operators import models as M
from marginalia.operators import rewards as R
from marginalia.sources import files as S


@pytest.mark.parametrize(
    "heights,spans,parents",
    [
        ([20, 12, 10, 10, 14, 10, 20, 8], [5, 2, 0, 0, 1, 0, 1, 0], [-1, 0, 1, 1, 0, 4, -1, 6]),
        ([20, 10, 10, 10], [3, 0, 0, 0], [-1, 0, 0, 0]),
        ([8, 20, 10], [0, 1, 0], [-1, -1, 1]),
        ([10, 10, 10], [0, 0, 0], [-1, -1, -1]),
        ([1200, 10], [0, 0], [-1, 0]),
    ],
)
def test_spans(heights, spans, parents):
    assert folds.spans_and_parents(heights) == (spans, parents)


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            diag = 0
            for j, y in enumerate(b):
                diag, row[j + 1] = row[j + 1], diag + 1 if x == y else max(row[j + 1], row[j])
        assert folds.common_subsequence(a, folds.bit_places(b), len(b)) == row[-1]


def test_span_rule_by_search():
    rng = random.Random(1)
    for _ in range(200):
        h = [rng.choice([8, 10, 12, 14]) for _ in range(rng.randint(1, 12))]
        s, p = folds.spans_and_parents(h)
        for i in range(len(h)):
            assert s[i] == next((j for j in range(i + 1, len(h)) if h[j] >= h[i]), len(h)) - i - 1
            assert p[i] == next((j for j in range(i - 1, -1, -1) if h[j] > h[i]), -1)


def elements(spark, heights, texts=None, pages=None):
    rows = [(1, i, (pages or [0] * 99)[i], (texts or "abcdefgh")[i], float(h)) for i, h in enumerate(heights)]
    return spark.createDataFrame(rows, "doc_id long, pos int, page int, text string, height double")


def test_tree_levels(spark):
    n = H.tree(elements(spark, [20, 12, 10, 10, 14, 10, 20, 8]))
    assert {r.depth: r.n_nodes for r in H.depth_histogram(n).collect()} == {0: 1, 1: 4, 2: 4}
    assert H.content_level(n).first().level == 0
    assert [r.text[-1] for r in H.leaf_sections(n).orderBy("sec_ord").collect()] == ["a", "c", "d", "f", "h"]


def test_page_prefix_modes(spark):
    n = H.tree(elements(spark, [20, 10, 10], ["A", "b", "c"], [0, 0, 1]))
    assert H.merge_leaves(n).first().text == "[Page:0] A [Page:1] c"
    assert H.merge_leaves(n, fixed=True).first().text == "[Page:0] A b [Page:1] c"


def test_repeated_blocks(spark):
    rows = [(1, 0, " Title ", 9.0), (1, 1, "x", 9.0), (1, 2, "Title", 9.0), (1, 3, "Title", 10.0), (2, 0, "", 9.0)]
    got = B.drop_repeated(spark.createDataFrame(rows, "doc_id long, pos int, text string, height double")).collect()
    assert sorted((r.doc_id, r.pos) for r in got) == [(1, 1), (1, 3), (2, 0)]


def test_short_sections(spark):
    def carry(lengths):
        rows = [(1, i, f"t{i + 1}", n) for i, n in enumerate(lengths)]
        return [r.text for r in H.carry_short(spark.createDataFrame(rows, "doc_id long, sec_ord long, text string, length long")).collect()]

    assert carry([3, 5, 9, 20]) == ["\nt1\nt2\nt3\nt4"]
    assert carry([20, 3, 5, 9]) == ["t1"]


def test_page_carry(spark):
    quotes = ["a", "[Page:3] b", "c", "[Page:0] d", "[Page:5] e", "f"]
    df = spark.createDataFrame([(1, i, q) for i, q in enumerate(quotes)], "doc_id long, ev int, quote string")
    assert [r.hint for r in E.carry_page(df, "doc_id", "ev", "quote").orderBy("ev").collect()] == [None, 3, 3, 3, 5, 5]


def test_srt(spark):
    text = "1\n00:00:00,000 --> 00:00:01,500\nChapter One. Start\n\n1\n00:00:02,000 --> 00:00:03,000\ndup\n\n2\nbad\nskipped\n\n3\n00:00:02,500 --> 00:00:04,000\nline a\nline b\n"
    got = C.parse_srt(spark.createDataFrame([(1, text)], "k long, value string"), "k").orderBy("idx").collect()
    assert [r.idx for r in got] == [1, 3] and got[1].stamped == "[00:00:02,500,00:00:04,000] line a\nline b"


def test_scalars(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("x")).first().x
    assert one(T.srt_ms(F.lit("01:02:03,456"))) == 3723456 and one(T.srt_ms(F.lit("1:2"))) is None
    assert one(T.srt_ms(F.lit("01:02:03,456"), strict=True)) == 3723456
    with pytest.raises(Exception, match="no time: 1:2"):
        one(T.srt_ms(F.lit("1:2"), strict=True))
    assert one(T.page_annotation(F.lit("[Page: 12 ] x"))) == 12 and one(T.page_annotation(F.lit(" [Page:5] x"))) is None
    assert one(T.clip_name(F.lit(3), F.lit(1200), F.lit("Hello, world. Is it ok?"))) == "snippet_003_1200_Hello_world_Is_it_ok"
    assert one(T.is_chapter(F.lit("see chapter 7: the end"))) and not one(T.is_chapter(F.lit("chapters 7")))
    assert one(T.words_of_number(F.lit(1000342))) == "One Million Three Hundred Forty Two"
    assert one(T.number_of_words(F.lit("two hundred and five thousand nine"))) == 205009


def test_intervals(spark):
    rows = [(1, i, s, e, "t") for i, (s, e) in enumerate([(0, 5000), (6000, 9000), (8000, 8500), (10001, 11000), (7, 7)])]
    got = C.merge_intervals(spark.createDataFrame(rows, "k long, o int, start_ms long, end_ms long, text string"), "k", "o").orderBy("grp").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 9000), (10001, 11000)]


def test_scores(spark):
    doc = "<summary>one two three</summary><verbatim_support>first long line here\nsecond long line here</verbatim_support>"
    df = spark.createDataFrame([(doc, "first long line here and second long line here"), (doc, "first long line here"), ("x", "y")], "c string, s string")
    got = df.select(R.format_score(F.col("c")).alias("f"), R.fidelity_score(F.col("c"), F.col("s")).alias("v"), R.fidelity_score(F.col("c"), F.col("s"), False).alias("n")).collect()
    assert [tuple(r) for r in got] == [(2.0, 5.0, 5.0), (2.0, -5.0, 0.0), (-10.0, -8.0, -8.0)]


def test_boxes():
    assert folds.merge_boxes([(0, 0, 10, 10), (12, 0, 20, 10), (100, 100, 110, 110)]) == [(0, 0, 20, 10), (100, 100, 110, 110)]
    assert folds.merge_pixels([(0, 0, 10, 10), (5, 5, 15, 15), (14, 14, 30, 30)]) == [(0, 0, 15, 15), (14, 14, 30, 30)]
    # from the top left on, whatever the order given: the lowest box is looked at last
    boxes = [(40, 40, 50, 50), (0, 30, 10, 40), (0, 0, 10, 32), (5, 0, 12, 10)]
    assert folds.merge_pixels(boxes) == [(0, 0, 12, 40), (40, 40, 50, 50)]
    assert folds.merge_pixels([(5, 9, 6, 10), (1, 2, 3, 4)]) == [(1, 2, 3, 4), (5, 9, 6, 10)]


def test_cue_packing():
    pack = lambda *rows, **o: [(c["start"], c["end"], c["text"]) for c in folds.pack_cues([{"start": a, "end": b, "text": t} for a, b, t in rows], **o)]
    assert pack((0.0, 1.0, "a"), (2.0, 3.0, "b"), (4.5, 5.0, "c"), (5.1, 6.0, "d")) == [(0.0, 3.0, "a b"), (4.5, 6.0, "c d")]
    # the first cue holds a blank more; a cue of the full length is cut
    assert pack((0.0, 1.0, "aaaa"), (1.0, 2.0, "bbbb"), most=10) == [(0.0, 1.0, "aaaa"), (1.0, 2.0, "bbbb")]
    assert pack((9.0, 9.5, "aaaa"), (9.5, 10.0, "bbbb"), most=10) == [(9.0, 10.0, "aaaa bbbb")]
    # an empty text opens no cue of its own
    assert pack((9.0, 9.5, ""), (9.6, 10.0, "x")) == [(9.6, 10.0, "x")]
    assert pack((9.0, 9.5, "y"), (30.0, 31.0, "")) == [(9.0, 9.5, "y")] and pack() == []


def test_words_join_to_blocks():
    words = [(0, 0, 10, 12, "a"), (12, 0, 20, 12, "b "), (21, 0, 30, 14, "c"), (90, 0, 99, 14, "d"), (99, 60, 110, 74, "e")]
    got = folds.merge_words([dict(zip(("x0", "y0", "x1", "y1", "text"), w)) for w in words], 5.0, 40.0)
    assert [(g["x0"], g["x1"], g["y1"], g["text"], g["height"]) for g in got] == [(0, 20, 12, "a b", 12), (21, 30, 14, "c", 14), (90, 99, 14, "d", 14), (99, 110, 74, "e", 14)]


def test_words_join_page_by_page(spark):
    rows = [(1, p, i, 10.0 * i, 0.0, 10.0 * i + 9, 12.0, f"w{p}{i}") for p in (0, 1) for i in (0, 1)] + [(1, 1, 2, 20.0, 0.0, 29.0, 12.0, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = B.merge_word_blocks(df, ["doc_id", "page"], ["word_no"], 600.0, 800.0).collect()
    assert sorted((r.page, r.text) for r in got) == [(0, "w00 w01"), (1, "w10 w11")]


def test_chunks_of_a_document(spark):
    rows = [(1, i, f"t{i + 1} " + "x" * 30, n) for i, n in enumerate([3, 20, 2, 30])]
    s = H.carry_short(spark.createDataFrame(rows, "doc_id long, sec_ord long, text string, length long"))
    got = [(r.chunk_index, r.text) for r in H.chunk(s, size=40, overlap=0).orderBy("chunk_index").collect()]
    x = "x" * 30
    # 75th percentile 22.5: only the last section is long, and the three before it go along; each fits alone
    assert got == [(0, f"t1 {x}"), (1, f"t2 {x}"), (2, f"t3 {x}"), (3, f"t4 {x}")]


def test_digits_only(spark):
    df = spark.createDataFrame([("12",), ("²³",), ("①",), ("1a",), ("½",), ("",), ("٣",)], "text string")
    assert sorted(r.text for r in B.drop_numeric(df).collect()) == sorted(t for t in ("12", "²³", "①", "1a", "½", "", "٣") if not t.isdigit())


def test_cue_match(spark):
    cues = spark.createDataFrame([(1, i, 10 * i, 10 * i + 5, t) for i, t in enumerate(["alpha beta", "gamma delta", "gamma delto", "alpha beta"])], "k long, idx int, start_ms int, end_ms int, text string")
    e = spark.createDataFrame([(1, 0, "gamma delto", 1, 3), (1, 1, "gamma delta", 0, 0), (1, 2, "alpha beta", 2, 3), (1, 3, "zzzz", 0, 0), (1, 4, "alpha", 1, 2)], "k long, ev int, quote string, lo int, hi int")
    got = {r.ev: (r.idx, r.score) for r in E.cue_match(e, cues, "k").collect()}
    # in range 1 to 3 the exact one ends the search; without a range all are tried, the first over the stop wins
    assert got[0] == (2, 1.0) and got[1] == (1, 1.0) and got[2] == (3, 1.0) and 3 not in got and 4 not in got


def test_chunk_of_ordinal(spark):
    chunks = spark.createDataFrame([(1, 0, 2, 0, 9), (1, 1, 0, 10, 19), (1, 2, 1, 20, 29)], "k long, chunk_index int, n int, start_index int, end_index int")
    e = spark.createDataFrame([(1, i, f"q{i}") for i in range(4)], "k long, ev int, quote string")
    got = {r.ev: (r.chunk_index, r.start_index) for r in E.chunk_of_ordinal(e, chunks, "k", "ev").collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (2, 20), 3: (None, None)}


def test_annotation_rows(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [(1, 0, 3, [(0.0, 0.0, 1.0, 1.0), (2.0, 0.0, 3.0, 1.0)], [(9.0, 9.0, 9.0, 9.0)], None), (1, 1, 3, [], [(5.0, 5.0, 6.0, 6.0), None], None), (1, 2, 4, None, None, (7.0, 7.0, 8.0, 8.0)), (1, 3, 4, None, [], None)]
    got = E.annotation_rows(spark.createDataFrame(rows, f"doc_id long, ev int, page int, instances array<{box}>, boxes array<{box}>, box {box}")).collect()
    assert sorted((r.ev, r.rect.x0 if r.rect else None, r.found) for r in got) == [(0, 0.0, True), (0, 2.0, True), (1, 5.0, True), (2, 7.0, True), (3, None, False)]


def test_joining_of_close_intervals(spark):
    rows = [(1, float(a), float(b)) for a, b in [(1, 5), (6, 9), (11, 15), (16, 20), (21, 25)]]
    got = C.join_close(spark.createDataFrame(rows, "k long, start double, end double"), "k").collect()
    assert sorted((r.start, r.end) for r in got) == [(1, 9), (11, 25)]


def test_layout_model(spark, tmp_path):
    from marginalia.operators import layout as Y

    rng = random.Random(3)
    rows = [(i, rng.gauss(4.0 * (i % 2), 0.5), rng.gauss(0, 1), ("single_column", "multi_column")[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, a double, b double, kind string")
    m = Y.LayoutModel.fit(df, "page_id", ["a", "b"], "kind")
    m.save(str(tmp_path / "model"))
    m = Y.LayoutModel.load(spark, str(tmp_path / "model"))
    page = spark.createDataFrame([(1, 4.1), (2, float("nan"))], "page_id long, a double")  # b is missing, one value is bad
    got = {r.page_id: (r.label, r.multi_column) for r in m.predict(page, "page_id").collect()}
    assert got == {1: ("multi_column", True), 2: ("single_column", False)} and 2 <= m.k <= 15


def test_six_classifiers_and_best_k(spark):
    from marginalia.operators import layout as Y

    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.gauss(3.0 * (i % 2), 1), rng.gauss(0, 1), float(i % 2)) for i in range(80)], "id long, a double, b double, label double")
    train, test = df.filter("id < 60"), df.filter("id >= 60")
    k, scores = Y.best_k(train.withColumn("v", F.array("a", "b")), test.withColumn("v", F.array("a", "b")), "id", "v", "label")
    assert [s[0] for s in scores] == list(range(2, 16)) and dict(scores)[k] == max(s for _, s in scores) and all(s < dict(scores)[k] for n, s in scores if n < k)
    got = {r.model: r.accuracy for r in Y.compare_with_neighbours(train, test, "id", ["a", "b"]).collect()}
    assert len(got) == 6 and all(0.5 <= a <= 1 for a in got.values()) and f"neighbours_{k}" in got


def test_split_of_small_classes(spark):
    from marginalia.operators import layout as Y

    assert Y.held_out_share(5) == (0.2, True) and Y.held_out_share(1) == (0.2, False)
    assert Y.held_out_share(3) == (0.2, True) and Y.held_out_share(4, 0.2) == (0.2, True)
    with pytest.raises(ValidationError):
        Y.held_out_share(0)
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(11)], "id long, label string")
    assert Y.split_rows(df, "label", "id").filter("is_test").count() == 2


def test_timings(spark):
    from marginalia.operators.runs import Timings

    t = Timings()
    with pytest.raises(ValueError):
        with t.stage("extract", "pdf"):
            assert t.running == 1
            raise ValueError("no")
    assert t.timed("load")(lambda x: x + 1)(1) == 2 and t.running == 0
    got = {r.stage: (r.status, r.seconds is not None, r.error_type) for r in t.frame(spark).collect()}
    assert got == {"extract": ("error", False, "ValueError"), "load": ("success", True, None)}


def test_recursive_split():
    t = "\n\n".join("para %d " % i + "x" * 50 for i in range(30))
    parts = folds.recursive_split(t, 200, 20)
    assert all(len(p) <= 200 for p in parts) and "para 29" in parts[-1]


def test_models(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(3)], "doc_id long, chunk_index int, text string")
    r = M.refine(df, "doc_id", lambda text, so_far: {"summary": f"{text}/{len(so_far)}", "evidence": [text]}).first()
    assert r.summary == "t0/0\nt1/4\nt2/9" and [e.verbatim_text for e in r.evidence] == ["t0", "t1", "t2"]
    e = M.extract_single(df, "text", lambda ps: ['{"summary": "s", "evidence": [{"verbatim_text": "v"}]}' for _ in ps]).first()
    assert e.result.summary == "s" and e.result.evidence[0].verbatim_text == "v"
    assert len(M.embed(df, "text", lambda ps: [[3.0, 4.0] for _ in ps]).first().embedding) == 2


def test_sources(spark, tmp_path):
    with pytest.raises(ValidationError):
        S.check_path(spark, "")
    with pytest.raises(ValidationError):
        S.check_path(spark, str(tmp_path / "none"))
    (tmp_path / "a.csv").write_text("filename,image_path,classification\nf,x.png,one\ng,/y.png,two\n")
    assert S.check_path(spark, str(tmp_path / "a.csv"))
    got = S.read_labelled_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r.image_path for r in got] == [f"{tmp_path}/x.png", "/y.png"]
    with pytest.raises(SourceError):
        S.first_source(lambda: spark.range(0))
    assert S.first_source(lambda: spark.range(0), lambda: spark.range(2))[1] == 1
    words = S.scan_words(S.binary_files(spark, str(tmp_path), "*.csv"), lambda b: [], lambda b: [(0, 0, 0.0, 0.0, 1.0, 1.0, "w", 0, 0)])
    assert words.first().text == "w"
    (tmp_path / "m").mkdir()
    (tmp_path / "c").mkdir()
    (tmp_path / "m" / "k.json").write_text('{"summary": "s", "chunk_files": ["chunk_000.json"], "total_evidence_count": 1}')
    (tmp_path / "c" / "chunk_000.json").write_text('{"summary": "s", "evidence": [{"verbatim_text": "v"}]}')
    r = S.read_cache(spark, str(tmp_path / "m"), str(tmp_path / "c")).first()
    assert (r.key, r.verbatim_text, r.start_index) == ("k", "v", -1)


def test_cache_files(spark, tmp_path):
    rows = [("a", 1, "two", ["q3"], 5, 9), ("a", 0, "one", ["q1", "q2"], 0, 4), ("b", None, "whole é", [], 0, 0)]
    df = spark.createDataFrame(rows, "key string, chunk_index int, summary string, evidence array<string>, start_index int, end_index int")
    got = {r.key: (r.n_files, r.total_evidence_count) for r in S.write_cache(df, str(tmp_path / "cache"), now="t").collect()}
    assert got == {"a": (2, 3), "b": (1, 0)}
    assert (tmp_path / "cache" / "b_chunks" / "chunk_all.json").read_text() == '{\n  "summary": "whole é",\n  "evidence": [],\n  "start_index": 0,\n  "end_index": 0\n}'
    back = S.read_cache(spark, str(tmp_path / "cache" / "a_master.json"), str(tmp_path / "cache" / "a_chunks")).collect()
    assert sorted((r.chunk_file, r.verbatim_text, r.start_index) for r in back) == [("chunk_000.json", "q1", 0), ("chunk_000.json", "q2", 0), ("chunk_001.json", "q3", 5)]
    assert {r.summary for r in back} == {"one\ntwo"}


def test_page_scans(spark, tmp_path):
    (tmp_path / "d.bin").write_text("ab c")
    files = S.binary_files(spark, str(tmp_path), "*.bin")

    def extract(content, page, classifier):
        if page == 1:
            raise ValueError("bad page")
        return [{"content": classifier(page), "occupy_space": (0, 0, 1, 1), "text_height_median": 9.0, "min_height": 8.0}, {"content": "lacks keys"}]

    got = S.scan_elements(files, lambda c: 3, extract, lambda: lambda p: f"p{p}").collect()
    assert [(r.page_num, r.pos, r.content) for r in got] == [(0, 0, "p0"), (2, 1, "p2")]
    word = lambda p, t: (p, 0, 0.0, 0.0, 1.0, 1.0, t, 0, 0)
    words = S.scan_words(files, lambda c: [word(0, "x"), word(1, " ")], page_ocr=lambda c, p: [word(p, f"ocr{p}")], pages=lambda c: 3).collect()
    assert [r.text for r in words] == ["x", "ocr1", "ocr2"]
    assert S.scan_words(files, lambda c: []).count() == 0
    with pytest.raises(Exception, match="no text in"):
        S.scan_words(files, lambda c: [], on_empty="raise").count()
    with pytest.raises(Exception, match="broken"):
        S.scan_words(files, lambda c: (_ for _ in ()).throw(ValueError("broken"))).count()
    assert S.scan_regions(files, lambda c: [(0, 0, 1, 1), (1, 1, 2, 2)]).count() == 2
    assert [s.text for s in M.transcribe(files, lambda c: [(0, 1.5, "hi")], lambda found, c: found + [(2, 3, "ho")]).first().segments] == ["hi", "ho"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "x long, y string")
    for _ in range(2):
        S.append_csv_file(df, str(tmp_path / "one.csv"))
        S.append_csv(df, str(tmp_path / "many"))
    assert (tmp_path / "one.csv").read_text().splitlines() == ["x,y", '1,"a,b"', "2,", '1,"a,b"', "2,"]
    assert spark.read.csv(str(tmp_path / "many"), header=True).count() == 4
    S.write_text(df.filter("x = 1"), "y", str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["a,b"]
    S.write_json(df, str(tmp_path / "json"), ["x"])
    assert {(r.x, r.y) for r in spark.read.json(str(tmp_path / "json")).collect()} >= {(1, "a,b")}
    j = spark.createDataFrame([('{"name":"é","children":[]}',)], "j string")
    assert j.select(S.pretty_json(F.col("j")).alias("p")).first().p == '{\n    "name": "é",\n    "children": []\n}'
    with pytest.raises(KeyError):
        S.task_status(df, "x", 9)
    assert S.task_status(df, "x", 1) == {"x": 1, "y": "a,b"}
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_text("x")
    paths = spark.createDataFrame([(f"{tmp_path}/img/a.png",), (f"{tmp_path}/img/none.png",)], "image_path string")
    assert S.only_files(spark, paths).count() == 1


def test_page_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my book.pdf").write_text("ab")
    (tmp_path / "in" / "bad.pdf").write_text("!")

    def render(content, page):
        if page == 1:
            raise ValueError("no")
        return b"png"

    files = S.binary_files(spark, str(tmp_path / "in"), "*.pdf")
    got = S.render_pages(files, lambda c: len(c) if c != b"!" else 1 // 0, render, str(tmp_path / "out"), "singlecolumn").collect()
    shown = sorted((r.path.rpartition("/")[2], r.page, r.image_path and r.image_path.rpartition("/")[2], r.error) for r in got)
    assert [x[3] for x in shown] == ["error_processing_file", None, "error_saving_image"] and shown[1][2] == "my_book_page_1.png"
    assert (tmp_path / "out" / "my_book_page_1.png").read_bytes() == b"png"


def test_hooks(spark):
    df = spark.createDataFrame([(1, "a b. c d", "x" * 60), (2, None, "short")], "id long, text string, long string")
    assert [r.sentences for r in M.split_sentences(df, "text").orderBy("id").collect()] == [["a b.", "c d"], []]
    assert [r.short for r in M.concise(df, "long", lambda t: "cut").orderBy("id").collect()] == ["cut", "short"]
    assert [r.entailment for r in M.entailment(df, "text", "long", lambda ps: [float(len(ps)) for _ in ps]).collect()]
    assert folds.rouge_l("the cats sat", "the cat sits") == pytest.approx(1 / 3)
    assert folds.rouge_l("the cats sat", "the cat sits", stem=lambda w: w[:3]) == pytest.approx(2 / 3)


def test_refine_when_a_model_fails(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(3)], "doc_id long, chunk_index int, text string")

    def model(text, so_far):
        if text == "t1":
            raise ValueError("no answer")
        return {"summary": text, "evidence": [text]}

    r = M.refine(df, "doc_id", model).first()
    assert (r.summary, r.n_failed) == ("t0\nt2", 1) and [e.chunk_index for e in r.evidence] == [0, 2]
    with pytest.raises(Exception, match="no answer"):
        M.refine(df, "doc_id", model, stop_on_error=True).collect()


def test_learning_curve(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    from marginalia.operators import layout as Y

    df = spark.createDataFrame([(float(i), float(i >= 30)) for i in range(60)], "a double, label double")
    got = Y.learning_curve(df, ["a"], "label", DecisionTreeClassifier(seed=1), sizes=(0.5, 1.0), folds=2).collect()
    assert {r.size for r in got} == {0.5, 1.0} and all(0.5 <= r["mean"] <= 1 for r in got)


def test_first_source_names_failures(spark):
    seen = []
    with pytest.raises(SourceError, match="0: broken"):
        S.first_source(lambda: (_ for _ in ()).throw(ValueError("broken")), failed=lambda i, e: seen.append(i))
    assert seen == [0]


def test_config(tmp_path):
    from marginalia.config import ConfigError

    assert EngineConfig.from_mapping({"merge_gap_ms": 5, "other": 1}).merge_gap_ms == 5
    (tmp_path / "c.json").write_text('{"audio": {"merge_gap_ms": 7}, "chunk_chars": 9}')
    c = EngineConfig.from_file(str(tmp_path / "c.json"))
    assert (c.merge_gap_ms, c.chunk_chars) == (7, 9)
    (tmp_path / "bad.json").write_text("[")
    with pytest.raises(ConfigError):
        EngineConfig.from_file(str(tmp_path / "bad.json"))


def test_streaming_intervals(spark, tmp_path):
    from marginalia.streaming.extensions import merge_intervals_stream

    rows = [(1, 0, 5), (1, 6, 9), (1, 40, 41), (2, 0, 1), (1, 100000, 100001)]
    df = spark.createDataFrame(rows, "k long, a long, b long").select("k", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = merge_intervals_stream(stream, "k", "1 second").writeStream.format("memory").queryName("merged").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.k, r.n_parts) for r in spark.table("merged").collect()}
    assert (1, 2) in got and (2, 1) in got


def test_streaming_counters(spark, tmp_path):
    from marginalia.streaming.extensions import run_counters_stream

    df = spark.createDataFrame([(0, "ok", 1.0), (60, "ok", 2.0), (60, "error", None), (4000, "ok", 5.0), (90_000, "ok", 1.0)], "a long, status string, seconds double")
    df.select(F.timestamp_seconds("a").alias("ts"), "status", "seconds").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, status string, seconds double").parquet(str(tmp_path / "in"))
    q = run_counters_stream(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start.timestamp(), r.status, r.n, r.seconds) for r in spark.table("counted").collect()}
    assert got == {(0.0, "ok", 2, 3.0), (0.0, "error", 1, None), (3600.0, "ok", 1, 5.0)}


def test_best_block_is_what_a_scan_in_order_finds():
    import random

    from marginalia.operators.folds import Blocks, ratio

    rng = random.Random(7)
    ends = set()
    for _ in range(400):
        q = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 40)))
        blocks = []
        for k in range(6):
            t = list(q)
            for _ in range(rng.choice((0, 1, 6, 20))):
                t[rng.randrange(len(t))] = rng.choice("abcdx")
            blocks.append((k // 2, k, rng.choice(("", "ab ")) + "".join(t)))
        best, want = 0.0, None
        for page, block, text in blocks:
            score = 1.0 if q in text else ratio(q, text)
            if score > best:
                best, want = score, (page, block, score)
            if q in text or score > 0.95:
                want = (page, block, score)
                break
        want = want if best >= 0.6 else None
        ends.add(want and want[2] > 0.95)
        got = Blocks(blocks).best(q, list(range(len(blocks))), 0.6, 0.95)
        assert (got and (*blocks[got[0]][:2], got[1])) == want and (not got or got[2] == (got[1] > 0.95))
    assert {True, False} <= ends
