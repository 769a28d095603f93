"""Token counts through a digest cache, and the encoder both token operators use.

Counts are stored under (digest of the content, digest of the tokenizer).  A
run joins the corpus' distinct digests to the cache, encodes only the misses
and appends them, so a second run over a grown corpus encodes what is new.

The content's normal form is its UTF-8 bytes with null as empty: byte-level
BPE has no normaliser, and any further folding would change counts.

Defined cases: null and empty texts have 0 tokens; repeated rows each keep
their row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, path_exists

_loaded: dict[str, object] = {}


def load(path: str):
    """The library's tokenizer for a file: tokenizers for .json, sentencepiece for .model."""
    if path not in _loaded:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = t
        else:
            from sentencepiece import SentencePieceProcessor

            _loaded[path] = SentencePieceProcessor(model_file=path)
    return _loaded[path]


#: The byte-level pre-tokenizer's split (public, fixed).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def file_encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids, as the library for the file gives them.

    A byte-level BPE file runs in tiktoken, whose ranks are the file's own ids;
    that is the same encoding if every merge makes a higher id than the one
    before and the file has no normaliser, which is checked.  Texts that hold an
    added token, and files that fail the check, go to the library.
    """
    import json

    t = load(path)
    if not path.endswith(".json"):
        return t.encode
    whole = lambda s: t.encode(s, add_special_tokens=False).ids
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
        return whole
    model, added = spec["model"], [x["content"] for x in spec.get("added_tokens") or []]
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return whole
    vocab, byte = model["vocab"], _byte_of()
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(b <= a for a, b in zip(made, made[1:])):
        return whole
    import tiktoken

    ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in added}
    try:
        fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    except ValueError:
        return whole
    return lambda s: whole(s) if any(a in s for a in added) else fast(s)


@lru_cache(maxsize=2)
def id_bytes(path: str) -> Callable[[str], bytes]:
    """text -> its ids, little-endian unsigned 32-bit."""
    encode = file_encoder(path)
    return lambda s: np.array(encode(s), "<u4").tobytes() if s else b""


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    encode = file_encoder(path)
    return lambda s: len(encode(s)) if s else 0


def version(path: str) -> str:
    """Digest of the tokenizer's file: another vocabulary has another cache key."""
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


CACHE = "content string, tokenizer string, n_tokens long"


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc row -> id, n_bytes, n_tokens; misses are encoded once and appended to cache_path."""
    spark, key = docs.sparkSession, version(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumns({"content": F.sha2("text", 256), "n_bytes": F.octet_length("text").cast("long")})
    # One text of each digest is enough; the map side already drops its own repeats.
    distinct = keyed.groupBy("content").agg(F.first("text").alias("text"))
    known = None
    if cache_path and path_exists(spark, cache_path):
        known = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == key)
        distinct = distinct.join(known, "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in batches:
            texts = b.column(1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([key] * b.num_rows, pa.string()), pa.array([count(texts[i].as_py()) for i in range(b.num_rows)], pa.int64())],
                ["content", "tokenizer", "n_tokens"],
            )

    fresh = distinct.select("content", "text").mapInArrow(encode, CACHE)
    if cache_path:
        fresh.write.mode("append").parquet(cache_path)
        stored = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer") == key)
        # Two runs at once may both append a digest.
        counts = materialize(stored.groupBy("content").agg(F.min("n_tokens").alias("n_tokens")), "token-counts")
    else:
        counts = materialize(fresh.select("content", "n_tokens"), "token-counts")
    # A plain table on this side lets adaptive execution split a hot digest of the other.
    return keyed.select("id", "n_bytes", "content").join(counts, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
