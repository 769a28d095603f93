"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from marginalia.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_features string, score int, rank int"


def runs(text, longest):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, longest=1, buckets=10_000, least_words=20, percent=10, seed=2024):
    counts = []
    for texts in ([t for _, t in docs], target):
        n = [0] * buckets
        for t in texts:
            for r in runs(t, longest):
                n[zlib.crc32(r.encode()) % buckets] += 1
        counts.append(n)
    (s, t), (s_all, t_all) = counts, map(sum, counts)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s_all + buckets) / ((s[i] + 1) * (t_all + buckets)))) for i in range(buckets)]
    out = []
    for d, text in docs:
        f = runs(text, longest)
        weight = sum(gain[zlib.crc32(r.encode()) % buckets] for r in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(runs(text, 1)), None])
    able = sorted((o for o in out if o[4] >= least_words), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1], o[2]))
    for i, o in enumerate(able[: percent * len(able) // 100]):
        o[5] = i + 1
    return sorted((tuple(o[:4] + o[5:]) for o in out), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def docs_of(spark, rows):
    return spark.createDataFrame([Row(d, t, "x", 7, 7) for d, t in rows] or [], SCHEMA)


@pytest.mark.parametrize("longest", [1, 3])
def test_plain_version(spark, longest):
    some = "The quick brown fox jumps over the lazy dog éàü 日本 x1 " * 4
    rows = [(i, some[i % 40 :] + f" w{i % 17} " * (i % 9)) for i in range(300)] + [(7, "again " * 30)] * 3 + [(None, some), (1000, None), (1001, ""), (1002, "?!"), (1003, "z" * 100_000 + " " + some)]
    target = [(1, "quick fox w3 w3"), (2, None), (3, "")]
    out = resample.resample(docs_of(spark, rows), docs_of(spark, target), longest=longest, least_words=10, percent=30)
    assert got(out) == plain(rows, [t for _, t in target], longest=longest, least_words=10, percent=30)


def test_empty_tables(spark):
    assert resample.resample(docs_of(spark, []), docs_of(spark, [])).collect() == []
    rows = [(i, f"word{i} " * 25) for i in range(20)]
    assert got(resample.resample(docs_of(spark, rows), docs_of(spark, []))) == plain(rows, [])
    # too few to draw one
    assert all(r["rank"] is None for r in resample.resample(docs_of(spark, rows[:9]), docs_of(spark, [])).collect())


def test_hot_score(spark):
    """Rows of one id and text share a score; each is drawn by itself and ranks stay without gaps."""
    rows = [(5, "same " * 30)] * 400 + [(i, f"other{i} " * 30) for i in range(100)]
    out = got(resample.resample(docs_of(spark, rows), docs_of(spark, [(1, "same")]), percent=50))
    assert sorted(r[4] for r in out if r[4]) == list(range(1, 251))
    assert out == plain(rows, ["same"], percent=50)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBZ09 é日\x00\x7f-_\n", max_size=200)), max_size=8), st.integers(1, 3), st.integers(8, 300))
def test_features(texts, longest, size):
    """Whatever the slices: every run's CRC in its row, words longer than the steps too."""
    old, resample.SLICE = resample.SLICE, size
    try:
        column = pa.array(["pad"] + [t and t.replace("日", "日" * 40) for t in texts], pa.string()).slice(1)
        found = [[] for _ in texts]
        for at, _, row, bucket in resample.features(column, longest, 1 << 31):
            for r, b in zip(row.tolist(), bucket.tolist()):
                found[at + r].append(b)
        assert [sorted(f) for f in found] == [sorted(zlib.crc32(r.encode()) % (1 << 31) for r in runs(t, longest)) for t in column.to_pylist()]
    finally:
        resample.SLICE = old
