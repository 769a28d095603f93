"""Registered queries that SQL can't express, against plain versions on the smallest tables."""

import difflib
from collections import defaultdict

from pyspark.sql import functions as F

from marginalia import plans
from marginalia.plans import inputs as I

SF = "/root/testdata/sf0.001"
Q = plans.queries()


def test_fuzzy_match_is_a_scan_in_order(spark):
    from marginalia.functions.text import normalize_ws
    from marginalia.plans.documents import _hinted

    quotes = _hinted(spark, SF).select("doc_id", "ev", "hint", normalize_ws(F.regexp_replace("quote", "e", "a")).alias("q")).filter("doc_id % 5 = 0").collect()
    blocks = defaultdict(list)
    for b in I.norm_blocks(spark, SF).orderBy("block").collect():
        blocks[b.doc_id].append(b)
    want = {}
    for e in quotes:
        if not e.q:
            continue
        near = blocks[e.doc_id]
        if e.hint is not None and e.hint >= 1 and any(b.page == e.hint for b in near):
            near = [b for p in (e.hint, e.hint - 2, e.hint - 1, e.hint + 1, e.hint + 2) for b in near if b.page == p]
        best, found = 0.0, None
        for b in near:
            if e.q in b.norm_text:
                best, found = 1.0, b
                break
            r = difflib.SequenceMatcher(None, e.q, b.norm_text).ratio()
            if r > best:
                best, found = r, b
            if r > 0.95:
                break
        if best >= 0.6:
            want[e.doc_id, e.ev] = (found.page, found.block, round(best, 6))
    got = {(r.doc_id, r.ev): (r.page, r.block, r.score) for r in Q["evidence_fuzzy_match"](spark, SF).filter("doc_id % 5 = 0").collect()}
    assert got == want and len(want) > 100


def test_chunks_are_the_carried_sections(spark):
    """No text here is longer than a chunk."""
    carried = defaultdict(list)
    for r in Q["short_section_carry"](spark, SF).orderBy("grp").collect():
        carried[r.doc_id].append(r.text.strip())
    got = defaultdict(list)
    for r in Q["chunks"](spark, SF).orderBy("chunk_index").collect():
        assert r.chunk_index == len(got[r.doc_id])
        got[r.doc_id].append(r.text)
    assert got == {d: t for d, t in carried.items() if any(t)}


def test_recursive_split_keeps_the_text(spark):
    texts = {r.doc_id: r.text for r in I.table(spark, SF, "documents").collect()}
    parts = defaultdict(list)
    for r in Q["recursive_split"](spark, SF).orderBy("part").collect():
        parts[r.doc_id].append(r.text)
    assert any(len(p) > 3 for p in parts.values())
    for d, p in parts.items():
        at = 0
        for x in p:
            assert 0 < len(x) <= 1000
            # each part goes on where the one before ended, less an overlap, and leaves out white space only
            start = texts[d].find(x, max(0, at - 101))
            assert start >= 0 and not texts[d][at:start].strip()
            at = start + len(x)
        assert not texts[d][at:].strip()
