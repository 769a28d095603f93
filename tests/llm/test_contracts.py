"""Each registered query against its brute-force version on the smallest tables."""

import duckdb
import pytest

import brute
from marginalia.llm import queries as q

SF = "/root/testdata/sf0.001"
nn = lambda v: None if v is None else int(v)


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(q.tokenizer_path())


def run(spark, name):
    return q.QUERIES[name](spark, SF).collect()


def test_warc(spark):
    want = brute.pages(duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall())
    assert {r.page_id: tuple(r)[1:] for r in run(spark, "op1_warc")} == want


def test_pii(spark, docs):
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in run(spark, "op2_pii")}
    assert got == {d: brute.personal(t)[0] for d, t in docs}


def test_secrets(spark, docs):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in run(spark, "op3_secrets")}
    assert got == {d: brute.secret(t) for d, t in docs}


def test_decontaminate(spark, docs):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, "op4_decontaminate")} == brute.contamination(docs, items)


def check_packing(rows, docs, tok):
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    assert got == {(d, p[0]): p[1:] for d, t in docs for p in brute.pack_ids(t, tok)}
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seqs) <= 1.02 * sum(r.length for r in rows) / 1024 + 1


def test_pack(spark, docs, tok):
    check_packing(run(spark, "op5_pack"), docs, tok)


def test_simhash(spark, docs):
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, "op6_simhash")} == brute.components(docs)


def test_quality(spark, docs):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in run(spark, "op7_quality")}
    assert got == {d: brute.quality(t) for d, t in docs}


def test_chunks(spark, docs):
    rows = run(spark, "op8_chunks")
    got = sorted((r.doc_id, r.start, r.end, r.n_chunks, r.n_bytes, tuple(r.first_ids), r.is_first, r.again) for r in rows)
    assert got == brute.passages(dict(docs)) and len(got) > 100


def test_tokens(spark, docs, tok):
    want = {}
    for d, t in docs:
        n = len(tok.encode(t or "", add_special_tokens=False))
        want[d] = (len((t or "").encode()), n, n > 512)
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, "op9_tokens")} == want


def test_licenses(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_base, nn(r.first_word), nn(r.last_word), r.base_labels) for r in run(spark, "op10_license")}
    assert got == {d: brute.licenses(t) for d, t in docs}


def test_pipeline(spark, docs, tok):
    import corpus_pipeline

    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    left = [(d, t) for d, t in docs if brute.quality(t)[6]]
    comp = brute.alike(left)
    assert any(comp[d] != d for d in comp)
    left = [(d, t) for d, t in left if comp[d] == d]
    hit = brute.contamination(left, items)
    left = [(d, t) for d, t in left if not hit[d][4]]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in left}
    clean = [(d, t) for d, t in left if not sum(brute.secret(t)[:3])]
    mine = {d for d, _ in clean}
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows if r.doc_id in mine}
    assert got == {(d, p[0]): p[1:] for d, t in clean for p in brute.pack_ids(t, tok)}
