"""Folds over groups in columns: what a batch takes in a worker, and that batches give what single groups give."""

import tracemalloc

import pyarrow as pa

from marginalia.operators import folds


def peak_mb(run, *columns):
    tracemalloc.start()
    try:
        out = run(*columns)
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()

def test_a_batch_of_painted_pages():
    """a page at a time is painted, from columns."""
    from marginalia.operators import raster as R

    page = [{"x0": 12.0 * (i % 40), "y0": 16.0 * (i // 40), "x1": 12.0 * (i % 40) + 7, "y1": 16.0 * (i // 40) + 10.0} for i in range(200)]
    pages = pa.array([page] * 300 + [page[:3]], pa.list_(pa.struct({c: pa.float64() for c in R.BOX})))
    mb, got = peak_mb(R._regions_udf(1.0).of_arrays, pages)
    assert mb < 25
    want = {n: [dict(zip(R.BOX, b)) for b in R.page_regions(R.paint(page[:n], 1.0), 1.0)] for n in (3, 200)}
    assert got.to_pylist() == [want[200]] * 300 + [want[3]]


def test_a_batch_of_pages_is_no_batch_of_dicts():
    """a page at a time is held as Python values, not all pages of a batch."""
    page = [{"x0": 10.0 * i, "y0": 0.0, "x1": 10.0 * i + 9, "y1": 12.0 + i // 10 % 2, "text": f" word{i} "} for i in range(200)]
    pages = pa.array([page] * 500 + [None, []], pa.list_(pa.struct({c: pa.string() if c == "text" else pa.float64() for c in page[0]})))
    size = lambda v: pa.array([v] * len(pages))
    mb, got = peak_mb(folds.merge_words_udf.of_arrays, pages[3:], size(5.0)[3:], size(40.0)[3:])
    assert mb < 20
    assert got.to_pylist() == [folds.merge_words(p or [], 5.0, 40.0) for p in pages[3:].to_pylist()]


def test_a_batch_of_recordings():
    """a recording at a time."""
    one = [{"text": f"t{i} " * (i % 7), "start": 2.0 * i, "end": 2.0 * i + (i % 3)} for i in range(200)]
    groups = pa.array([one] * 500 + [one[:1], None], pa.list_(pa.struct({"text": pa.string(), "start": pa.float64(), "end": pa.float64()})))
    mb, got = peak_mb(folds.pack_cues_udf.of_arrays, groups[1:])
    assert mb < 40
    assert got.to_pylist() == [folds.pack_cues(g or []) for g in groups[1:].to_pylist()]


def test_a_batch_of_long_texts():
    """of a batch the parts are held as columns; a text at a time is cut."""
    texts = [f"{i} " + "some words " * 4000 for i in range(100)] + [None, ""]
    mb, got = peak_mb(folds.recursive_split_udf(1000, 100).of_arrays, pa.array(texts))
    assert mb < 5
    assert got.to_pylist()[-3:] == [folds.recursive_split(t or "", 1000, 100) for t in texts[-3:]]
