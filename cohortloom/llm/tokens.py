"""Token counts by a public byte-level tokenizer; the path of its ranks is a parameter."""

from __future__ import annotations

import base64
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def process_cache() -> dict:
    """What a Python worker keeps between tasks: in a module of its own, as functions are sent to workers by value."""
    return sys.modules.setdefault("_cohortloom_process_cache", types.ModuleType("_cohortloom_process_cache")).__dict__


def encoder(path: str = RANKS):
    """The tokenizer of this process and the byte length of each of its tokens; read once per process."""
    import tiktoken

    held = process_cache().setdefault("encoders", {})
    if path not in held:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for b, r in ranks.items():
            size[r] = len(b)
        held[path] = (enc, size)
    return held[path]


def with_tokens(df: DataFrame, text: str, path: str = RANKS, out: str = "n_tokens") -> DataFrame:
    """df without its text, with the number of tokens of the whole text; null and empty texts have none."""
    rest = [f for f in df.schema.fields if f.name != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in names), pa.array(n, pa.int64())], [*names, out])

    from pyspark.sql import types as T

    names = [f.name for f in rest]
    return df.mapInArrow(count, T.StructType([*rest, T.StructField(out, T.LongType())]))


def no_text(c: str):
    """Null or empty."""
    return F.col(c).isNull() | (F.length(c) == 0)
