"""The pipeline's stages one by one: nulls, ties, repeated rows and ids, empty tables, clashing names."""

import pytest

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_chars long, lang string, __q_rest string, __q_kept boolean, __digest string, __done string, __b_hit string, __id long, __text string, n_words long, id long, component long"


def prose(tag, n=30):
    return " ".join(f"{tag}{i}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, prose("a")), (2, prose("a")), (2, prose("b")), (3, prose("c")), (3, prose("d")), (3, prose("d")), (None, prose("a")), (None, prose("e")),
        (4, None), (5, ""), (6, "too short"), (7, prose("f") + " token=abcdefgh1 end"), (8, prose("g", 20_000)), (9, "same " * 50),
    ]
    return spark.createDataFrame([(i, t, len(t or ""), "en", *[None] * 10) for i, t in rows], SCHEMA)


def texts(df):
    return sorted(((r.doc_id, (r.text or "")[:12]) for r in df.collect()), key=repr)


def test_each_stage(spark, docs):
    assert docs.columns == p.quality_rules(spark, docs, SF).columns
    kept = p.quality_rules(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, 8, None} and kept.count() == 10
    left = p.near_dedup(spark, docs, SF)
    assert left.columns == docs.columns
    want = [(1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "e"), (4, ""), (6, "t"), (7, "f"), (8, "g"), (9, "s")]
    assert sorted(((r.doc_id, (r.text or "")[:1]) for r in left.collect()), key=repr) == sorted(want, key=repr)
    for stage in (p.benchmark_decontamination, p.secret_redaction):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == docs.count()
    clean = p.secret_redaction(spark, docs, SF).filter("doc_id = 7").first()
    assert clean.text.endswith(" [SECRET] end") and clean.n_chars == len(clean.text)
    packed = p.best_fit_packing(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert sum(r.piece == 0 for r in packed) == docs.count()


def test_secret_redaction_goes_through_the_ledger(spark, docs, monkeypatch):
    """by op3's method: a ledger holds each distinct text once, with the findings that are redacted in all rows of the text."""
    from marginalia.llm import secrets
    from marginalia.llm.common import new_path

    path = new_path(spark, "test-pipeline-ledger")
    monkeypatch.setattr(p, "new_path", lambda *a: path, raising=False)
    twice = docs.union(docs.filter("doc_id = 7"))
    out = p.secret_redaction(spark, twice, SF)
    rows = lambda df: sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=repr)
    assert rows(out) == rows(secrets.redact_texts(twice, length_col="n_chars"))
    ledger = spark.read.parquet(path)
    assert ledger.count() == len({r.text or "" for r in docs.collect()})
    assert [[f.kind for f in r.findings] for r in ledger.collect() if r.findings] == [["assign"]]
    assert sum("[SECRET]" in (r.text or "") for r in out.collect()) == 2


def test_stages_over_an_empty_table(spark, docs):
    none = docs.filter("doc_id = -1")
    for _, stage in p.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_near_dedup_meets_at_simhash_anchors(spark, monkeypatch):
    """copies within four bits are found by op6's anchors alone; a pair they connect still needs the shingles' similarity."""
    from marginalia.llm import similar, simhash

    words = prose("h", 600).split()
    rows = [(1, " ".join(words)), (2, " ".join(words[:599] + ["z"])), (3, prose("k", 600)), (4, " ".join(words).upper()), (5, ""), (6, " "), (7, "a b c d"), (8, "A b  c d")]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= 4 < (prints[0] ^ prints[2]).bit_count()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked, real = [], similar.link
    monkeypatch.setattr(similar, "link", lambda d, *a: asked.append({r.fp for r in d.select("fp").collect()}) or real(d, *a))
    own = similar.band_groups
    monkeypatch.setattr(similar, "band_groups", lambda nodes: own(nodes).filter("false"))
    assert sorted(r.doc_id for r in p.near_dedup(spark, df, SF).collect()) == [1, 3, 5, 7]
    assert [len(a) for a in asked] == [len(set(prints))]
    monkeypatch.setattr(similar, "anchor_pairs", lambda nodes: nodes.selectExpr("node as u", "node as v").filter("false"))
    assert p.near_dedup(spark, df, SF).count() == 8
