"""Text sizes in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Vocabulary file: one base64 token and its rank a line.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this tokenizer cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_count(text: Column, ranks: str = RANKS) -> Column:
    """Number of tokens of a whole text; 0 for null and for the empty text."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(ranks)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where the scan itself has fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
