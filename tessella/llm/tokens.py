"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer, loaded once per Python worker; where the path isn't there, from the file that the driver sent along."""
    import tiktoken

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def with_tokens(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without its text, with its size in column ``tokens`` (in place of one of that name); null and empty texts have none."""
    df.sparkSession.sparkContext.addFile(vocabulary)  # workers need not have it
    keep = [c for c in df.columns if c not in (text_col, "tokens")]
    rows = df.select(*keep, F.col(text_col).alias("_text"))

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].fillna("").tolist()
            yield batch[keep].assign(tokens=[len(x) for x in encoder(vocabulary).encode_ordinary_batch(texts, num_threads=1)] if texts else [])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long"
    return rows.mapInPandas(count, schema)
