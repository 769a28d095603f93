"""Stateful streams against their batch forms: late rows, restarts, idle keys."""

import random
import statistics

import pytest

from pyspark.sql import functions as F

from marginalia.operators import cues as C
from marginalia.streaming import stateful as T


def feed(spark, folder, name, schema, build, batches, mode):
    """Run a stream over batches, one file each, stopping and starting it again between them; rows of each batch."""
    source, out = folder / "in", []
    source.mkdir()

    def keep(df, _):
        out.append([tuple(r) for r in df.collect()])

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"part{i}"))
        (next((folder / f"part{i}").glob("*.parquet"))).rename(source / f"{i}.parquet")
        stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)).withColumn("ts", F.timestamp_seconds("s")))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(folder / "cp")).foreachBatch(keep).start()
        q.processAllAvailable()
        q.stop()
    return out


@pytest.mark.parametrize("seed", [1])
def test_running_median(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(k, 1000 + i * 10, rng.choice((1.0, 2.0, 3.5, 7.0, -1.0, None))) for i in range(30) for k in "ab"]
    batches = [rows[:24], rows[24:60], [("a", 1300, 100.0), ("a", 1020, 1e9), ("c", 1310, 4.0)], [("z", 100_000, 1.0)], [("z", 100_010, 2.0), ("a", 100_020, 8.0)]]
    got = feed(spark, tmp_path, "median", "k string, s long, v double", lambda d: T.running_median(d, "k", "v", late="1 minute", idle="10 minutes"), batches, "update")
    flat = [r for b in got for r in b]
    plain = lambda k, upto: statistics.median([v for b in batches[:upto] for kk, s, v in b if kk == k and v is not None and v < 1e9])
    # after two batches; the checkpoint carried the first one's values over a restart
    assert [r[2] for r in flat if r[0] == "b" and not r[3]][-1] == plain("b", 2)
    # the late value (1,020 s, when the watermark was at 1,230 s) is out
    last = [r for r in flat if r[0] == "a" and not r[3]]
    assert any(r[2] == plain("a", 3) and r[1] == sum(1 for b in batches[:3] for kk, _, v in b if kk == "a" and v is not None and v < 1e9) for r in last)
    # silent keys are closed once, and start anew
    assert sorted(r[0] for r in flat if r[3]) == ["a", "b", "c"]
    assert last[-1] == ("a", 1, 8.0, False)


def test_running_median_equals_the_batch_median(spark, tmp_path):
    rows = [(r.user_id, r.s, r.value) for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "value").collect()]
    rows = sorted(rows, key=lambda r: r[1])[:1500]
    third = len(rows) // 3
    got = feed(spark, tmp_path, "median2", "k long, s long, v double", lambda d: T.running_median(d, "k", "v", late="1 hour", idle="36500 days"), [rows[:third], rows[third : 2 * third], rows[2 * third :]], "update")
    last = {r[0]: (r[1], r[2]) for b in got for r in b}
    want = {r.k: (r.n, r.m) for r in spark.createDataFrame(rows, "k long, s long, v double").groupBy("k").agg(F.count("v").alias("n"), F.median("v").alias("m")).collect()}
    assert last.keys() == want.keys() and all(last[k][0] == want[k][0] and last[k][1] == pytest.approx(want[k][1]) for k in want)


def test_chapters(spark, tmp_path):
    """All chapters of the batch query come out, whatever order the cues came in within the watermark."""
    rng = random.Random(2)
    cues, at = [], 0
    for i in range(120):
        at += rng.randint(1, 9)
        for k in (1, 2):
            cues.append((k, at, i, "Chapter 5 begins" if rng.random() < 0.12 or i == 0 else f"line {i}"))
    mixed = sorted(cues, key=lambda c: c[1] + rng.uniform(-25, 25))
    batches = [mixed[:70], mixed[70:150], mixed[150:], [(9, 50_000, 0, "line")], [(9, 50_010, 1, "line"), (1, 10, 999, "Chapter 6")]]
    schema = "k long, s long, idx long, text string"
    from marginalia.functions.text import is_chapter

    got = feed(spark, tmp_path, "chapters", schema, lambda d: T.chapters(d.withColumn("mark", is_chapter(F.col("text"))), "k", late="1 minute", idle="10 minutes"), batches, "append")
    want = C.chapters(spark.createDataFrame(cues, schema), "k").collect()
    assert sorted(r for b in got for r in b) == sorted((r.k, r.chapter, r.first_idx, r.last_idx, r.n_cues) for r in want)
    assert len(want) > 10 and sum(map(bool, got)) > 1


def test_batch_window_is_what_the_stream_counts(spark):
    """The batch form numbers chapters by marks behind the first cue."""
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Chapter 1", "a", "Chapter 2", "b"])], "k long, idx long, text string")
    assert [(r.chapter, r.n_cues) for r in C.chapters(df, "k").orderBy("chapter").collect()] == [(0, 2), (1, 2)]
