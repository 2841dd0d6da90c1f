"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import UNICODE_SPACE

#: A byte-level vocabulary in rank form; every worker reads it there.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, carried columns, n_tokens) of every text that isn't null or blank; whole texts are counted."""
    carry = carry or []
    kinds = dict(df.dtypes)
    texts = df.select(F.col(id_col), *carry, F.col(text_col).alias("_text")).filter(F.col("_text").rlike(f"[^{UNICODE_SPACE}]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [id_col, *carry, "n_tokens"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *carry)) + ", n_tokens bigint"
    return texts.repartition(2 * df.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
