"""Corpus pipeline: quality, near-dedup, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
its result is written as Parquet and read again as the next one's docs.  All
but the last return the columns of documents, whatever these are called.

Defined cases, beside those of the operators: a null text is an empty one (too
short, so quality_rules rejects it); a null id is a document like any other;
rows that share an id are judged each by its own text; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, pack, quality, secrets, similar
from marginalia.llm.common import cols, materialize, new_path, own_prefix, ship, table
from marginalia.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; repeated rows are judged alike."""
    ship(spark)
    q = own_prefix(docs, "__q_")
    return quality.quality(docs, carry=tuple(docs.columns), prefix=q).filter(q + "kept").select(*cols(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.

    Near copies: five-word shingles of a Jaccard similarity of at least 0.8.  Of
    rows that repeat an id and its text one stays; of an id's different texts
    each is judged by itself; a null id counts as the largest.  Texts meet at the
    SimHash anchors of op6; the pairs these can't meet share MinHash bands (README).
    """
    ship(spark)
    return similar.drop_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; without a benchmark all stay."""
    ship(spark)
    b = own_prefix(docs, "__b_")
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns), prefix=b)
    return hits.filter(F.size(b + "hit") == 0).select(*cols(docs))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays, repeated rows too.

    By op3's method: each distinct text is scanned once, into a fresh blob ledger,
    and the findings are joined back to the rows that hold it.
    """
    return secrets.redact_texts(docs, new_path(spark, "pipeline-ledger"), length_col="n_chars" if "n_chars" in docs.columns else None)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences of 1024 tokens; repeated rows are packed each."""
    ship(spark)
    return pack.pack_documents(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_redaction", secret_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: Stages call tokenizers, MinHash prints and suffix arrays, which SQL can't express; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
