"""Token counts of texts under a public byte-level BPE."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary's merges were made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER_FILE) -> tiktoken.Encoding:
    """The tokenizer of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER_FILE) -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` of the whole text (0 for null).

    The vocabulary file is read once per Python worker; text goes through in
    Arrow batches and does not come back.
    """
    kept = documents.select(*keep, text)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return kept.mapInArrow(count, f"{schema}, n_tokens BIGINT")
