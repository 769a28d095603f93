"""Durable refinement: what has been answered is never asked again."""

import pytest

from marginalia.operators.refine import refine_rounds

CHUNKS = [(d, i, f"text {d}.{i}") for d, n in (("a", 4), ("b", 2), ("c", 1), ("d", 3)) for i in range(n)]


def Model(folder, fails=()):  # noqa: N802
    """A model that counts its calls in a folder, one file a call, and fails where told."""
    folder = str(folder)

    def ask(text, so_far):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(f"{text}|{so_far}")
        if text in fails:
            raise ValueError(f"no answer to {text}")
        return {"summary": f"<{text}>", "evidence": [text, f"{len(so_far)}"]}

    return ask


def calls(folder):
    return sorted(p.read_text() for p in folder.iterdir())


@pytest.fixture
def at(tmp_path):
    def make(name):
        p = tmp_path / name
        p.mkdir()
        return p

    return make


def frame(spark, rows=CHUNKS):
    return spark.createDataFrame(rows, "doc string, chunk_index int, text string")


def rows(df):
    return {r.doc: (r.summary, [(e.chunk_index, e.verbatim_text) for e in r.evidence], [(e.chunk_index, e.error) for e in r.errors]) for r in df.collect()}


def test_fold(spark, tmp_path, at):
    seen = at("calls")
    got = rows(refine_rounds(frame(spark), "doc", Model(seen), str(tmp_path / "cache")))
    assert got["a"][0] == "\n".join(f"<text a.{i}>" for i in range(4)) and got["c"] == ("<text c.0>", [(0, "text c.0"), (0, "0")], [])
    assert got["b"][1] == [(0, "text b.0"), (0, "0"), (1, "text b.1"), (1, str(len("<text b.0>")))]
    assert len(calls(seen)) == len(CHUNKS)
    # again: nothing is asked
    assert rows(refine_rounds(frame(spark), "doc", Model(seen), str(tmp_path / "cache"))) == got and len(calls(seen)) == len(CHUNKS)


def test_resume_after_failure(spark, tmp_path, at):
    """A run that fails in its third round has asked rounds 1 and 2; the next run asks the rest only."""
    first, second, whole = at("first"), at("second"), at("whole")
    cache = str(tmp_path / "cache")
    with pytest.raises(Exception, match="no answer to text a.2"):
        refine_rounds(frame(spark), "doc", Model(first, ["text a.2"]), cache, stop_on_error=True)
    done = {c for c in calls(first) if c.split("|")[0][-1] in "01"}
    assert len(done) == 7
    got = rows(refine_rounds(frame(spark), "doc", Model(second), cache))
    assert {c.split("|")[0] for c in calls(second)} == {"text a.2", "text a.3", "text d.2"} and len(calls(second)) == 3
    assert got == rows(refine_rounds(frame(spark), "doc", Model(whole), str(tmp_path / "other")))


def test_errors_are_kept(spark, tmp_path, at):
    seen, cache = at("calls"), str(tmp_path / "cache")
    got = rows(refine_rounds(frame(spark), "doc", Model(seen, ["text a.1", "text c.0"]), cache))
    assert got["a"][0] == "\n".join(f"<text a.{i}>" for i in (0, 2, 3)) and got["a"][2] == [(1, "ValueError: no answer to text a.1")]
    assert got["c"] == ("", [], [(0, "ValueError: no answer to text c.0")])
    # failed chunks, and those that saw another summary, are asked again
    n = len(calls(seen))
    again = rows(refine_rounds(frame(spark), "doc", Model(seen), cache, retry_errors=True))
    assert again["a"][2] == again["c"][2] == [] and len(calls(seen)) == n + 4


def test_changed_documents(spark, tmp_path, at):
    seen, cache = at("calls"), str(tmp_path / "cache")
    refine_rounds(frame(spark), "doc", Model(seen), cache)
    n = len(calls(seen))
    new = [(d, i, "changed" if (d, i) == ("d", 1) else t) for d, i, t in CHUNKS if d != "b"] + [("e", 7, None)]
    got = rows(refine_rounds(frame(spark, new), "doc", Model(seen), cache))
    assert set(got) == {"a", "c", "d", "e"} and got["d"][0] == "<text d.0>\n<changed>\n<text d.2>"
    assert len(calls(seen)) == n + 3  # d.1, d.2 behind it, e.7


def test_no_chunks(spark, tmp_path, at):
    assert refine_rounds(frame(spark, []), "doc", Model(at("calls")), str(tmp_path / "cache")).count() == 0
