"""Counters, duration histograms and timings of runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper bounds of a histogram's buckets in seconds (fixed values); the last is open.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def counters(runs: DataFrame, *labels: str) -> DataFrame:
    """Runs by their labels: n; without labels one row."""
    return runs.groupBy(*labels).agg(F.count("*").alias("n"))


def counters_by(runs: DataFrame, sets: list[tuple[str, ...]], seconds: str = "seconds") -> DataFrame:
    """Runs counted under several sets of labels in one aggregate: labels (null where a set lacks one), set_id, n, seconds.

    set_id has a bit for each label, in the order in which they first occur, the
    first label's the highest; it is 1 where the set lacks the label.
    """
    labels = list(dict.fromkeys(x for s in sets for x in s))
    grouped = runs.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in labels])
    return grouped.agg(F.grouping_id().alias("set_id"), F.count("*").alias("n"), F.sum(seconds).alias("seconds"))


def job_state(status: Column) -> Column:
    """completed for a success, failed for anything else."""
    return F.when(status == "success", "completed").otherwise("failed")


def latest(rows: DataFrame, ts: str, tie: str, n: int = 5) -> DataFrame:
    """The n newest rows, a report of that length."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def histogram(runs: DataFrame, labels: list[str], seconds: str = "seconds", buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Labels, le (upper bound, infinite for the last), n (at most le), total and sum; only finished runs have seconds."""
    done = runs.filter(F.col(seconds).isNotNull())
    counts = [F.count_if(F.col(seconds) <= b).alias(f"__{i}") for i, b in enumerate(buckets)]
    g = done.groupBy(*labels).agg(*counts, F.count("*").alias("total"), F.sum(seconds).alias("sum"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"__{i}").alias("n")) for i, b in enumerate(buckets)], F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return g.select(*labels, F.inline(rows), "total", "sum")


def active(marks: DataFrame, ts: str = "ts", change: str | Column = "change", slot: str = "day") -> DataFrame:
    """Gauge of running jobs after each mark: starts (1) less ends (-1) up to it.

    The marks of a slot are one task's; the slots before it enter as one sum.
    """
    c = F.col(change) if isinstance(change, str) else change
    m = marks.withColumns({"__slot": F.date_trunc(slot, F.col(ts)), "__c": c})
    # one row a slot
    sums = m.groupBy("__slot").agg(F.sum("__c").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__slot", before.alias("__before"))
    w = Window.partitionBy("__slot").orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    return m.withColumn("__in", F.sum("__c").over(w)).join(sums, "__slot").withColumn("active", F.col("__in") + F.col("__before")).drop("__slot", "__c", "__in", "__before")


def cache_counters(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """One row: hits and misses of the wanted keys in the stored ones."""
    have = stored.select(key).distinct().withColumn("__have", F.lit(True))
    hit = F.count_if(F.col("__have"))
    return wanted.join(have, key, "left").agg(hit.alias("hits"), (F.count("*") - hit).alias("misses"))


class Timings:
    """Rows of stages as they run: seconds only on success; the number running falls in any case."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.running = 0

    @contextmanager
    def stage(self, name: str, label: str = "") -> Iterator[None]:
        self.running += 1
        began = time.time()
        try:
            yield
        except BaseException as e:
            self.rows.append((began, name, label, "error", None, type(e).__name__))
            raise
        else:
            self.rows.append((began, name, label, "success", time.time() - began, None))
        finally:
            self.running -= 1

    def timed(self, name: str, label: str = "") -> Callable:
        def wrap(f: Callable) -> Callable:
            def call(*args, **kwargs):
                with self.stage(name, label):
                    return f(*args, **kwargs)

            call.__name__, call.__doc__ = f.__name__, f.__doc__
            return call

        return wrap

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "began double, stage string, label string, status string, seconds double, error_type string").withColumn("began", F.timestamp_seconds("began"))
