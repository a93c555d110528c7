"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict = {}
_SHIPPED: dict[str, set[str]] = {}


def encoding(vocabulary: str = VOCABULARY):
    if vocabulary not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
        _ENCODINGS[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[vocabulary]


def shipped(spark: SparkSession, vocabulary: str) -> str:
    """Sends the vocabulary file to every executor; returns its name there. The session's
    ``spark.almudi.vocabulary`` stands for the default path."""
    path = spark.conf.get("spark.almudi.vocabulary", VOCABULARY) if vocabulary == VOCABULARY else vocabulary
    if path not in _SHIPPED.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(path)
        _SHIPPED[spark.sparkContext.applicationId].add(path)
    return Path(path).name


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of whole texts; null and blank texts have 0 tokens.

    ``source`` is trimmed and lower-cased, '' where missing.
    """

    name = shipped(documents.sparkSession, vocabulary)

    def run(batches):
        enc = encoding(SparkFiles.get(name))
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t and t.strip() else 0 for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "n_tokens": n})

    return documents.select("doc_id", F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source"), "text").mapInPandas(run, "doc_id long, source string, n_tokens long")
