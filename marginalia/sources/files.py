"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExtractionError, SourceError, ValidationError
from ..functions.text import base_name, clip_name, safe_name

WORD = "path string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string, block_no int, line_no int"
CACHE_MASTER = "summary string, chunk_files array<string>, total_evidence_count int, timestamp string"
CACHE_CHUNK = "summary string, evidence array<struct<verbatim_text:string>>, start_index int, end_index int"


_own_folder: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share, removed when the application ends.

    That is spark.checkpoint.dir; where it is unset a temporary folder, in local mode only.
    """
    import tempfile
    import uuid

    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or _own_folder.get(sc.applicationId)
    if not base:
        if sc.master.split("[")[0] != "local":
            raise SourceError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_folder[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    path = f"{base.rstrip('/')}/marginalia/{name}-{uuid.uuid4().hex}"
    hp = sc._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hp)
    return path


def check_path(spark: SparkSession, path: str | None) -> str:
    """The path, if it names a readable file; raises ValidationError."""
    if not path:
        raise ValidationError("no path given")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise ValidationError(f"no such file: {path}")
    if not fs.getFileStatus(p).isFile():
        raise ValidationError(f"not a file: {path}")
    try:
        f = fs.open(p)
        f.read()
        f.close()
    except Exception as e:
        raise ValidationError(f"can't be read: {path}") from e
    return path


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


_WORD_TYPES = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.int32(), pa.int32()]


def _batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
    cols = [[path] * len(rows), *map(list, zip(*rows))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _WORD_TYPES)], [x.split()[0] for x in WORD.split(", ")])


def scan_words(
    files: DataFrame, reader: Callable[[bytes], list[tuple]], ocr: Callable[[bytes], list[tuple]] | None = None, page_ocr: Callable[[bytes, int], list[tuple]] | None = None,
    pages: Callable[[bytes], int] | None = None, on_empty: str = "skip",
) -> DataFrame:
    """Word rows of documents through an injected reader.

    reader and ocr give (page, word_no, x0, y0, x1, y1, text, block_no, line_no).
    A document without words goes to ocr; of one with some, each page without
    any goes to page_ocr(content, page), pages(content) telling their number.
    A document that gives nothing at all is skipped, or with on_empty="raise"
    an ExtractionError.  An error of the reader is one, unless ocr takes over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda rows: [w for w in rows if w[6] and w[6].strip()]
        for b in batches:
            for r in b.to_pylist():
                path, content = r["path"], r["content"]
                try:
                    rows = shown(reader(content))
                except Exception as e:
                    if ocr is None:
                        raise ExtractionError(f"{path}: {e}") from e
                    rows = []
                if not rows and ocr:
                    rows = shown(ocr(content))
                elif rows and page_ocr and pages:
                    have = {w[0] for w in rows}
                    rows += [w for p in range(pages(content)) if p not in have for w in shown(page_ocr(content, p))]
                    rows.sort(key=lambda w: w[0])
                if rows:
                    yield _batch(path, rows)
                elif on_empty == "raise":
                    raise ExtractionError(f"no text in {path}")

    return files.select("path", "content").mapInArrow(run, WORD)


ELEMENT = "path string, page_num int, pos int, content string, x0 double, y0 double, x1 double, y1 double, text_height_median double, min_height double"
#: what an element must have to count
ELEMENT_KEYS = ("content", "occupy_space", "text_height_median")


def scan_elements(files: DataFrame, pages: Callable[[bytes], int], extract: Callable[[bytes, int, Callable | None], list[dict]], load_classifier: Callable[[], Callable] | None = None) -> DataFrame:
    """Elements of all pages of documents, in the pages' reading order.

    extract(content, page, classifier) gives an element's content, occupy_space
    (x0, y0, x1, y1), text_height_median and min_height.  Elements that lack a
    key are skipped, and so is a page that fails; the number of skipped ones
    goes to the worker's log.  The classifier is loaded once a task; if that
    fails pages are extracted without it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import logging

        log, classifier = logging.getLogger("marginalia"), None
        if load_classifier:
            try:
                classifier = load_classifier()
            except Exception as e:
                log.warning("no layout classifier: %s", e)
        names = [x.split()[0] for x in ELEMENT.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 6]
        for b in batches:
            for r in b.to_pylist():
                rows: list[tuple] = []
                for p in range(pages(r["content"])):
                    try:
                        found = extract(r["content"], p, classifier)
                        good = [e for e in found if all(k in e for k in ELEMENT_KEYS)]
                        made = [(r["path"], p, len(rows) + i, e["content"], *map(float, e["occupy_space"]), e["text_height_median"], e.get("min_height")) for i, e in enumerate(good)]
                    except Exception as e:
                        log.warning("%s: page %d skipped: %s", r["path"], p, e)
                        continue
                    if len(good) < len(found):
                        log.warning("%s: page %d: %d elements lack a key", r["path"], p, len(found) - len(good))
                    rows += made
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("path", "content").mapInArrow(run, ELEMENT)


def scan_regions(images: DataFrame, find: Callable[[bytes], list[tuple[float, float, float, float]]]) -> DataFrame:
    """Boxes of page images through an injected raster pipeline: path, region_ord, x0, y0, x1, y1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, i, *map(float, box)) for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, box in enumerate(find(content))]
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.string(), pa.int32(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", "region_ord", "x0", "y0", "x1", "y1"])

    return images.select("path", "content").mapInArrow(run, "path string, region_ord int, x0 double, y0 double, x1 double, y1 double")


def first_source(*readers: Callable[[], DataFrame], failed: Callable[[int, Exception], None] | None = None) -> tuple[DataFrame, int]:
    """The first reader that gives rows, and its place.

    Readers that fail are told to `failed`; if none gives rows a SourceError
    names every failure.
    """
    errors: list[str] = []
    for i, read in enumerate(readers):
        try:
            df = read()
            if not df.isEmpty():
                return df, i
            errors.append(f"{i}: no rows")
        except Exception as e:
            errors.append(f"{i}: {e}")
            if failed:
                failed(i, e)
    raise SourceError("no source gave rows (" + "; ".join(errors) + ")")


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """filename, image_path, classification; relative image paths start at the file's folder."""
    df = spark.read.csv(path, header=True)
    lacking = {"filename", "image_path", "classification"} - set(df.columns)
    if lacking:
        raise ValidationError(f"missing columns: {sorted(lacking)}")
    folder = path.rstrip("/").rpartition("/")[0]
    df = df.filter("image_path is not null and trim(image_path) <> ''")
    return df.withColumn("image_path", F.when(F.col("image_path").startswith("/"), F.col("image_path")).otherwise(F.concat(F.lit(folder + "/"), "image_path")))


PAGE_IMAGE = "path string, page int, image_path string, classification string, error string"


def render_pages(files: DataFrame, pages: Callable[[bytes], int], render: Callable[[bytes, int], bytes], folder: str, label: str) -> DataFrame:
    """Page images of documents, one file a page, and their labelled rows.

    File names are {document's safe name}_page_{n}.png, n from 1.  A page that
    can't be saved has a row with error error_saving_image, a document that
    can't be read one with error_processing_file.
    """
    top = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, place = fs.FileSystem.from_uri(top) if "://" in top else (fs.LocalFileSystem(), top.removeprefix("file:"))
        for b in batches:
            rows = []
            for path, content, name in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    n = pages(content)
                except Exception:
                    rows.append((path, None, None, label, "error_processing_file"))
                    continue
                for p in range(n):
                    image, error = f"{place}/{name}_page_{p + 1}.png", None
                    try:
                        data = render(content, p)
                        where.create_dir(place, recursive=True)
                        with where.open_output_stream(image) as f:
                            f.write(data)
                    except Exception:
                        image, error = None, "error_saving_image"
                    rows.append((path, p, image, label, error))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in PAGE_IMAGE.split(", ")])

    return files.select("path", "content", safe_name(base_name(F.col("path"))).alias("name")).mapInArrow(run, PAGE_IMAGE)


def only_files(spark: SparkSession, df: DataFrame, column: str = "image_path", glob: str = "*") -> DataFrame:
    """Rows whose path names a file; the folders' listing decides, not a request a row."""
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    folders = [r[0] for r in df.select(F.regexp_extract(column, "^(.*)/", 1)).distinct().collect()]  # a data set's few folders
    have = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folders).select(bare(F.col("path")).alias("__path"))
    return df.join(have, bare(F.col(column)) == F.col("__path"), "left_semi")


def append_csv(df: DataFrame, path: str) -> None:
    """Append to a folder of CSV files.  Every part has its header, which read.csv(header=True) takes from each."""
    df.write.mode("append").csv(path, header=True)


def append_csv_file(df: DataFrame, path: str) -> None:
    """Append to one CSV file, with a header only if it is new or empty; rows come to the driver part by part."""
    import csv
    import os

    new = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "a", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        if new:
            out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(row)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """path, value: one row per subtitle file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_cache(spark: SparkSession, master: str, chunks: str) -> DataFrame:
    """Quotes of cached model answers: key, chunk_file, summary, ev, verbatim_text, start_index, end_index; unreadable files are skipped."""
    m = spark.read.schema(CACHE_MASTER).option("multiLine", True).option("mode", "PERMISSIVE").json(master).withColumn("key", base_name(F.input_file_name()))
    c = spark.read.schema(CACHE_CHUNK).option("multiLine", True).option("mode", "DROPMALFORMED").json(chunks)
    c = c.select(F.concat(base_name(F.input_file_name()), F.lit(".json")).alias("chunk_file"), "evidence", F.coalesce("start_index", F.lit(-1)).alias("start_index"), F.coalesce("end_index", F.lit(-1)).alias("end_index"))
    files = m.select("key", "summary", F.posexplode("chunk_files").alias("n", "chunk_file"))
    return files.join(c, "chunk_file").select("key", "summary", "n", "chunk_file", F.posexplode("evidence").alias("ev", "e"), "start_index", "end_index").select("key", "summary", "n", "chunk_file", "ev", "e.verbatim_text", "start_index", "end_index")


def write_cache(chunks: DataFrame, folder: str, key: str = "key", concise: str | None = None, now: str | None = None) -> DataFrame:
    """Cache files of model answers: a folder of chunk files and a master file a key.

    chunks: key, chunk_index (null for a whole document: chunk_all.json), summary,
    evidence (array of verbatim_text), and perhaps start_index, end_index and the
    column named by concise.  Files: {key}_chunks/chunk_{index:03d}.json and
    {key}_master.json.  A key is written by one task, each file in one piece.
    Returns a row per key: key, master, n_files, total_evidence_count.
    """
    import datetime

    stamp = now or str(datetime.datetime.now())
    has = [c for c in ("start_index", "end_index") if c in chunks.columns]

    def run(t: pa.Table) -> pa.Table:
        import json

        from pyarrow import fs

        rows = sorted(t.to_pylist(), key=lambda r: (r["chunk_index"] is not None, r["chunk_index"] or 0))
        name = rows[0][key]
        where, top = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        where.create_dir(f"{top}/{name}_chunks", recursive=True)

        def put(path: str, value: dict) -> None:
            with where.open_output_stream(path) as f:
                f.write(json.dumps(value, ensure_ascii=False, indent=2).encode())

        names, total = [], 0
        for r in rows:
            names.append("chunk_all.json" if r["chunk_index"] is None else f"chunk_{r['chunk_index']:03d}.json")
            total += len(r["evidence"] or [])
            put(f"{top}/{name}_chunks/{names[-1]}", {"summary": r["summary"], "evidence": [{"verbatim_text": e} for e in r["evidence"] or []]} | {c: r[c] for c in has})
        summary = "\n".join(r["summary"] or "" for r in rows).strip()
        master = {"summary": summary} | ({"concise_summary": rows[0][concise]} if concise else {})
        put(f"{top}/{name}_master.json", master | {"chunk_files": names, "total_evidence_count": total, "timestamp": stamp})
        return pa.table({key: [name], "master": [f"{top}/{name}_master.json"], "n_files": pa.array([len(names)], pa.int32()), "total_evidence_count": pa.array([total], pa.int32())})

    picked = chunks.select(key, F.col("chunk_index").cast("int"), "summary", F.transform("evidence", lambda e: e.cast("string")).alias("evidence"), *has, *([concise] if concise else []))
    return picked.groupBy(key).applyInArrow(run, f"{key} {chunks.schema[key].dataType.simpleString()}, master string, n_files int, total_evidence_count int")


def clip_rows(cues: DataFrame, key: str, tail_ms: int = 100) -> DataFrame:
    """Clips to cut: key, idx, start_ms, end_ms with the tail, and the file's name."""
    return cues.select(key, "idx", "start_ms", (F.col("end_ms") + tail_ms).alias("end_ms"), clip_name(F.col("idx"), F.col("start_ms"), F.col("text")).alias("file_name"))


def pretty_json(column, indent: int = 4):
    """A JSON text laid out over lines, letters as they are."""
    import json

    def lay_out(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=indent))

    return F.pandas_udf(lay_out, "string")(column)


def task_status(tasks: DataFrame, key: str, wanted) -> dict:
    """The one task of this id; KeyError if there is none."""
    found = tasks.filter(F.col(key) == F.lit(wanted)).limit(1).collect()
    if not found:
        raise KeyError(wanted)
    return found[0].asDict()


def cache_usable(summary, n_snippets):
    """A cached answer counts if it has a summary or a snippet."""
    return (F.length(F.coalesce(summary, F.lit(""))) > 0) | (n_snippets > 0)


def write_json(df: DataFrame, path: str, partition: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*partition).json(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def unfinished(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs without a finished output: what a resumed run has left to do."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def grouped_listing(files: DataFrame) -> DataFrame:
    """Files (path, length) with a wanted suffix, grouped by stem up to the first underscore."""
    f = files.filter(F.col("path").rlike(r"\.(pdf|json|txt)$")).withColumn("stem", base_name(F.col("path")))
    return f.groupBy(F.element_at(F.split("stem", "_"), 1).alias("group")).agg(F.array_sort(F.collect_list(F.struct("path", "length"))).alias("files"))
