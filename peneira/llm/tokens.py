"""Sizes and offsets in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to the byte-level vocabulary files.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER):
    """The tokenizer of a vocabulary file, loaded once a process."""
    import tiktoken

    # A worker on another machine has the file that shipped() gave it.
    own = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    with open(own, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_SHIPPED: set[tuple[str, str]] = set()


def shipped(spark: SparkSession, path: str = TOKENIZER) -> str:
    """Gives the vocabulary file to the executors, once an application; returns the path."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHIPPED and os.path.exists(path):
        _SHIPPED.add(key)
        spark.sparkContext.addFile(path)
    return path


def counts(texts: list[str | None], path: str = TOKENIZER) -> np.ndarray:
    """Tokens of each text; a null has none."""
    encode = encoder(path).encode_ordinary
    return np.fromiter((len(encode(t)) if t else 0 for t in texts), np.int64, len(texts))


def sized(rows: DataFrame, doc_id: str, text: str, keep: list[str] = (), path: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens, kept columns) of every row, whole texts; a null or empty text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(counts(batch.column("text_").to_pylist(), path))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *[batch.column(k) for k in keep]], ["doc_id", "tokens", *keep])

    shipped(rows.sparkSession, path)
    own = rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text_"), *[F.col(k) for k in keep])
    kept = "".join(f", {k} {own.schema[k].dataType.simpleString()}" for k in keep)
    return own.mapInArrow(run, f"doc_id bigint, tokens bigint{kept}")
