"""Lengths of texts in tokens of a public tokenizer, whose path is a parameter. The tokenizer is loaded once a worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file of byte-level BPE, and the pattern that splits text before its merges.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Replaces the text by ``tokens``, the length of the whole text; a null or empty text has 0."""
    keep = [c for c in df.columns if c != text]

    def count(batches):
        enc = encoder(path, pattern)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), n], [*keep, "tokens"])

    return df.mapInArrow(count, df.select(*keep, F.lit(0).cast("long").alias("tokens")).schema)
