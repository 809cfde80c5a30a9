"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.runtime import widen

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: The rank file counted with, and the pattern that splits text before its merges.
RANKS = "byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoding(folder: str = TOKENIZERS, name: str = RANKS):
    """The tokenizer of a rank file; one for each Python worker."""
    if (folder, name) not in _loaded:
        import tiktoken

        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[folder, name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[folder, name]


def not_blank(text: str = "text") -> Column:
    """Whether a text holds more than white space."""
    return F.col(text).rlike(r"[^\s\x{a0}\x{3000}\x{200b}\x{feff}]")


def token_sizes(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), folder: str = TOKENIZERS, name: str = RANKS) -> DataFrame:
    """(key, keep..., n_tokens, n_bytes) of every row with non-blank text, whole texts counted.

    Null and blank texts give no row; repeated keys give a row each. Strings of
    special tokens count as ordinary text.
    """
    picked = widen(docs.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text")).filter(not_blank("_text")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoding(folder, name)
        for batch in batches:
            texts = batch["_text"]
            yield batch.drop(columns="_text").assign(
                n_tokens=pd.Series([len(e.encode_ordinary(t)) for t in texts], dtype="int64", index=batch.index),
                n_bytes=pd.Series([len(t.encode("utf-8", "replace")) for t in texts], dtype="int64", index=batch.index),
            )

    kinds = dict(picked.dtypes)
    schema = f"_key {kinds['_key']}, " + "".join(f"_c{i} {kinds[f'_c{i}']}, " for i in range(len(keep))) + "n_tokens bigint, n_bytes bigint"
    return picked.mapInPandas(count, schema).select(F.col("_key").alias(key), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_bytes")
