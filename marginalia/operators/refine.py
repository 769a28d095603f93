"""Durable refinement: the fold of a language model over a document's chunks, in rounds.

Round r asks the model for the r-th chunk of every document that has one, with the
summary so far.  Its answers are appended to a cache table before round r + 1
begins, under a digest of what was asked, and a round asks only what the cache
doesn't answer.  So a run that failed, or lost its driver, goes on with the first
question that has no answer, and a run over changed documents asks again from the
first changed chunk on.  Documents are independent: one slow or failing document
holds up no other within a round.

Cache: a Parquet table, partitioned by round: doc, digest, chunk_index, summary,
evidence, error, running (the summary with this chunk's).  A chunk whose call
failed has its message in error and adds nothing to the summary; with
``retry_errors`` such rows count as unanswered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANSWER = "summary string, evidence array<string>, error string"


def _path_exists(spark, path: str) -> bool:
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp)


def _ask(model: Callable[[str, str], dict], fail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for text, so_far in zip(b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.schema.get_field_index("so_far")).to_pylist()):
                try:
                    got = model(text, so_far)
                    made.append((got["summary"], list(got["evidence"]), None))
                except Exception as e:
                    if fail:
                        raise
                    made.append((None, [], f"{type(e).__name__}: {e}"))
            names = [n for n in b.schema.names if n != "text"]
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            types = (pa.string(), pa.list_(pa.string()), pa.string())
            new = [pa.array(c, t) for c, t in zip(list(zip(*made)) or ([], [], []), types)]
            yield pa.RecordBatch.from_arrays(cols + new, [*names, "summary", "evidence", "error"])

    return run


def refine_rounds(chunks: DataFrame, doc: str, model: Callable[[str, str], dict], cache: str, joiner: str = "\n", stop_on_error: bool = False, retry_errors: bool = False) -> DataFrame:
    """doc, summary, evidence (array of chunk_index, verbatim_text, in order), errors (array of chunk_index, error).

    chunks: doc, chunk_index, text.  model: (text, summary so far) -> {"summary",
    "evidence"}.  cache: the folder of the cache table, new or of an earlier run.
    With stop_on_error a failing call fails the run; what earlier rounds and other
    runs have answered stays answered.  Joins are merges: no round's rows go
    through the driver.
    """
    spark = chunks.sparkSession
    kind = chunks.schema[doc].dataType.simpleString()
    asked_row = f"`{doc}` {kind}, digest string, chunk_index long, so_far string, {ANSWER}"
    row = asked_row + ", running string"
    turn = F.row_number().over(Window.partitionBy(doc).orderBy("chunk_index")) - 1
    todo = chunks.select(doc, F.col("chunk_index").cast("long").alias("chunk_index"), "text").withColumn("round", turn.cast("int"))
    last = todo.agg(F.max("round")).first()[0]
    running, used = None, []
    for r in range(0 if last is None else last + 1):
        now = todo.filter(F.col("round") == r).drop("round")
        now = now.withColumn("so_far", F.lit("")) if running is None else now.hint("merge").join(running, doc)
        asked = now.withColumn("digest", F.sha2(F.concat_ws("\u0000", F.coalesce("text", F.lit("")), "so_far", F.col("chunk_index").cast("string")), 256))
        path = f"{cache}/round={r}"
        held = spark.read.schema(row).parquet(path) if _path_exists(spark, path) else None
        if held is not None and retry_errors:
            held = held.filter("error is null")
        fresh = asked if held is None else asked.hint("merge").join(held.select(doc, "digest"), [doc, "digest"], "left_anti")
        answered = fresh.select(doc, "digest", "chunk_index", "so_far", "text").mapInArrow(_ask(model, stop_on_error), asked_row)
        grown = F.when(F.col("summary").isNull(), F.col("so_far")).when(F.col("so_far") == "", F.col("summary")).otherwise(F.concat("so_far", F.lit(joiner), "summary"))
        answered.withColumn("running", grown).write.mode("append").parquet(path)
        # Of the cache's rows those that answer what is asked now; of repeated answers one.
        own = spark.read.schema(row).parquet(path)
        best = own.hint("merge").join(asked.select(doc, "digest"), [doc, "digest"], "left_semi")
        best = best.groupBy(doc, "digest").agg(F.min_by(F.struct("chunk_index", "summary", "evidence", "error", "running"), F.col("error").isNotNull()).alias("a")).select(doc, "a.*")
        running = best.select(doc, F.col("running").alias("so_far"))
        used.append(best.withColumn("round", F.lit(r)))
    if not used:
        return spark.createDataFrame([], f"`{doc}` {kind}, summary string, evidence array<struct<chunk_index:long,verbatim_text:string>>, errors array<struct<chunk_index:long,error:string>>")
    every = used[0]
    for u in used[1:]:
        every = every.unionByName(u)
    parts = F.array_sort(F.collect_list(F.struct("round", "chunk_index", "evidence", "error")))
    out = every.groupBy(doc).agg(F.max_by("running", "round").alias("summary"), parts.alias("p"))
    quotes = F.flatten(F.transform("p", lambda x: F.transform(x["evidence"], lambda e: F.struct(x["chunk_index"].alias("chunk_index"), e.alias("verbatim_text")))))
    errors = F.transform(F.filter("p", lambda x: x["error"].isNotNull()), lambda x: F.struct(x["chunk_index"].alias("chunk_index"), x["error"].alias("error")))
    return out.select(doc, "summary", quotes.alias("evidence"), errors.alias("errors"))
