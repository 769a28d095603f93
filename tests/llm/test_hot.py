"""Long passages, pages of one template, hot digests, columns of any name."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import chunks, similar, warc

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_a_passage_with_a_ruled_line_is_whole(spark):
    """1,075 characters, 600 of them one ruled line: no cut inside that line, and the end is found all the same."""
    rng = random.Random(1)
    body = words(rng, 80)[:474] + " "
    passage = body + "-" * 600
    rows = [(i, f"{words(rng, 60)} {i} {passage}{i} {words(rng, 60)}") for i in range(3)]
    got = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, text in rows:
        at = text.index(body)
        spans = [(r.start, r.end) for r in got if r.doc_id == i]
        assert any(s <= at and e >= at + len(passage) for s, e in spans), (at, spans)
        assert all(e <= at + len(passage) + 2 and s >= at - 2 for s, e in spans)


def test_ruled_lines_longer_than_a_chunk(spark):
    """Cuts by length differ from text to text; the ends are those of the plain version all the same."""
    import brute

    rng = random.Random(7)
    docs = {}
    for k, line in enumerate(("-" * 3000, "=-" * 900, "x" * 1500 + "y" * 1500)):
        passage = f"{words(rng, 15)} {line} {words(rng, 15)}"
        for i in range(3):
            docs[10 * k + i] = f"{words(rng, 40)} {i} {passage} {i} {words(rng, 40)}"
        docs[10 * k + 5] = f"{words(rng, 30)} {line[:2500]} {words(rng, 30)}"
    got = chunks.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end, r.n_chunks, r.n_bytes, tuple(r.first_ids), r.is_first, r.again) for r in got) == brute.passages(docs)


@pytest.mark.parametrize("size", [150, 199])
def test_short_passages_count(spark, size):
    rng = random.Random(size)
    passage = words(rng, 60)[:size]
    rows = [(i, f"{words(rng, 80)}|{passage}|{words(rng, 80)}") for i in range(40)]
    got = chunks.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if r.end - r.start >= size}
    # one so short may hold no whole chunk in some surroundings, and is then not seen there
    assert len(found) >= 30


def test_more_text_never_goes_on_beyond_the_bound():
    """The next chunk and reach + 4 bytes hold all that two texts can share behind a cut they share."""
    rng = random.Random(5)
    for _ in range(200):
        shared = words(rng, rng.randint(5, 60)) + rng.choice(("", "-" * rng.randint(0, 2500), "ab" * rng.randint(0, 1500)))
        a, b = (f"{words(rng, 20)} {shared}{x} {words(rng, 300)}".encode() for x in "xy")
        cuts = [chunks.boundaries(np.frombuffer(t, np.uint8)).tolist() for t in (a, b)]
        ends = [[s - t.index(shared.encode()) for s in c] for t, c in zip((a, b), cuts)]
        n = len(shared)
        common = sorted(set(e for e in ends[0] if 0 < e <= n) & set(e for e in ends[1] if 0 < e <= n))
        for own in ends:
            if common and (nxt := [e for e in own if e > common[-1]]):
                assert n - common[-1] < nxt[0] - common[-1] + 28 + 4


def template_pages(rng, n, own=80):
    body = words(rng, 400)
    return [(i, body + " " + words(rng, own)) for i in range(n)]


def test_pages_of_one_template_meet_in_their_cells(spark):
    """Pages alike to 0.7 are no links, and none of their pairs leaves a cell or compares two sets."""
    rng = random.Random(3)
    rows = template_pages(rng, 300) + [(1000 + i, t + " w") for i, (_, t) in enumerate(template_pages(rng, 3)[:1] * 2)]
    seen = []
    real = similar.Members.links

    def counted(self, sets, least):
        compare = similar.similar
        similar.similar = lambda *a: seen.append(1) or compare(*a)
        try:
            return real(self, sets, least)
        finally:
            similar.similar = compare

    texts = [similar.shingle_hashes(t.encode()) for _, t in rows[:300]]
    prints = [similar.prints(t.encode()) for _, t in rows[:300]]
    import pyarrow as pa

    two = 2 * 300
    t = pa.table({
        "node": list(range(300)) * 2, "root": list(range(300)) * 2, "home": [True] * 300 + [False] * 300, "size": [p[2] for p in prints] * 2, "print": pa.array([p[1] for p in prints] * 2, pa.binary()),
        "band": [0] * two, "top": [0] * two,
    })
    m = similar.Members(t, similar.most_apart(0.8))
    m.low[:, 0] = 7  # all share the first band
    assert counted(m, texts * 2, 0.8) == [] and not seen
    got = {r.doc_id: r.component for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i in range(300)) and got[1000] == got[1001] == 1000


def test_cells_find_the_links_that_sets_give(spark):
    """Chains of copies at 0.8 and above, some across cells, against exact similarity."""
    rng = random.Random(8)
    rows = []
    for f in range(12):
        base = words(rng, 120).split()
        for c in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = "x" + str(rng.random())
            rows.append((f * 100 + c, " ".join(t)))
    sets = {i: similar.shingle_hashes(t.encode()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and similar.similar(sets[i], sets[j], 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cell in (similar.CELL, 3):
        got = {r.doc_id: r.component for r in similar.similar_groups(df, cell=cell).collect()}
        assert got == {i: find(i) for i in sets}


def test_a_hot_digest_is_split(spark):
    """The join of equal payloads' rows has two plain sides, so adaptive execution may split it."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        pages = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.when(F.col("id") % 20 < 17, "").otherwise(F.col("id").cast("string")).alias("html"))
        df = warc.plan_records(pages)
        rows = df.groupBy("record_type").count().collect()
        assert {r.record_type: r["count"] for r in rows} == {"response": 6001, "revisit": 33_999}
        df.write.format("noop").mode("overwrite").save()
        out = warc.plan_records(pages).filter("record_type = 'revisit'")
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_columns_of_any_name(spark):
    """Dots and blanks in names: all stages keep the columns as they are (mapInArrow itself takes no backtick in a name)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.withColumns({"a.b": F.lit(1), "e f": F.lit(None).cast("string"), "text.x": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert {r["a.b"] for r in out.collect()} == {1}
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() > 0
