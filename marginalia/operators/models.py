"""Injected models: any callable takes the place of OCR, speech, language or embedding services."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_SCHEMA = "struct<summary:string,evidence:array<struct<verbatim_text:string>>>"


def prompt(template: Column | str, content: Column, running: Column | None = None) -> Column:
    """Template, content and, from the second chunk on, the summary so far."""
    t = F.lit(template) if isinstance(template, str) else template
    parts = F.concat(t, F.lit("\n\n"), content)
    return parts if running is None else F.when(running.isNull() | (running == ""), parts).otherwise(F.concat(parts, F.lit("\n\nSummary so far:\n"), running))


def prompt_mode(words: Column, limit: int) -> Column:
    return F.when(words <= limit, "single").otherwise("chunked")


def extract_single(df: DataFrame, text: str, model: Callable[[list[str]], list[str]], batch: int = 16) -> DataFrame:
    """Adds result: the model's JSON for each prompt, parsed; unparsable answers are null."""

    @F.pandas_udf("string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            values = s.tolist()
            yield pd.Series([a for i in range(0, len(values), batch) for a in model(values[i : i + batch])])

    return df.withColumn("result", F.from_json(ask(F.col(text)), SUMMARY_SCHEMA))


def refine(chunks: DataFrame, doc: str, model: Callable[[str, str], dict], joiner: str = "\n", stop_on_error: bool = False) -> DataFrame:
    """Chunks of a document in order, each seeing the running summary: doc, summary, evidence, n_failed.

    Sequential within a document, parallel over documents.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_index")
        parts, evidence, failed = [], [], 0
        for r in pdf.itertuples():
            try:
                got = model(r.text, joiner.join(parts))
                parts.append(got["summary"])
                evidence += [{"chunk_index": int(r.chunk_index), "verbatim_text": e} for e in got["evidence"]]
            except Exception:
                if stop_on_error:
                    raise
                failed += 1
        return pd.DataFrame({doc: [pdf[doc].iloc[0]], "summary": [joiner.join(parts)], "evidence": [evidence], "n_failed": [failed]})

    kind = chunks.schema[doc].dataType.simpleString()
    return chunks.groupBy(doc).applyInPandas(run, f"{doc} {kind}, summary string, evidence array<struct<chunk_index:int,verbatim_text:string>>, n_failed long")


def concise(df: DataFrame, text: str, model: Callable[[str], str], least: int = 50) -> DataFrame:
    """Adds short: the model's shorter form; texts under `least` characters stay."""

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or len(t) < least else model(t))

    return df.withColumn("short", ask(F.col(text)))


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 128) -> DataFrame:
    """Adds embedding (array<float>), L2-normalised."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(s), batch):
            for v in model(s.iloc[i : i + batch].tolist()):
                n = sum(x * x for x in v) ** 0.5 or 1.0
                out.append([x / n for x in v])
        return pd.Series(out)

    return df.withColumn("embedding", run(F.col(text)))


def entailment(df: DataFrame, premise: str, hypothesis: str, model: Callable[[list[tuple[str, str]]], list[float]], batch: int = 64) -> DataFrame:
    """Adds entailment probability of each pair."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a, b))
        return pd.Series([p for i in range(0, len(pairs), batch) for p in model(pairs[i : i + batch])])

    return df.withColumn("entailment", run(F.col(premise), F.col(hypothesis)))


def split_sentences(df: DataFrame, text: str, splitter: Callable[[str], list[str]] | None = None) -> DataFrame:
    """Adds sentences by an injected splitter; the default cuts after . ! ? and white space."""
    from .folds import sentences

    cut = splitter or sentences

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: cut(t or ""))

    return df.withColumn("sentences", run(F.col(text)))


SEGMENT = "array<struct<start:double,end:double,text:string>>"


def transcribe(files: DataFrame, speech: Callable[[bytes], list[tuple[float, float, str]]], align: Callable[[list, bytes], list] | None = None, content: str = "content") -> DataFrame:
    """Adds segments (start, end, text) of recordings; align refines them to the sound, null for an empty recording."""

    @F.pandas_udf(SEGMENT)
    def run(s: pd.Series) -> pd.Series:
        def one(data):
            if not data:
                return None
            found = speech(bytes(data))
            found = align(found, bytes(data)) if align else found
            return [{"start": float(a), "end": float(b), "text": t} for a, b, t in found]

        return s.map(one)

    return files.withColumn("segments", run(F.col(content)))
