"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file of the vocabulary; nothing of it is kept here. All executors must have it at this path.
VOCABULARY = os.environ.get("SPANLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    """The encoding function of a rank file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_count(text: str | None, path: str = VOCABULARY) -> int:
    """The number of tokens of a text; 0 for None and the empty text."""
    return len(_encoder(path)(text)) if text else 0


def with_token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Columns `keep` and n_tokens (bigint); 0 for null and empty texts. One pass over the texts, no shuffle, and, unlike
    a function in a column, none that the optimizer could make a second time for a filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [token_count(t, path) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(count, f"{schema}, n_tokens bigint")
