"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE vocabulary, one "base64 rank" a line. Must be readable on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level BPE cuts text into pieces before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file, read once per process."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, text: str, output: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the number of tokens of ``text`` (null for a null text, 0 for an empty one) and drops the text itself.

    Whole texts are encoded, in place; nothing is shuffled. All other columns stay, whatever their names; one called
    ``output`` is replaced.
    """
    kept = [c for c in df.columns if c not in (text,) and c.lower() != output.lower()]
    names = [f"c{i}" for i in range(len(kept))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            sizes = [None if t is None else len(own.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*names, "tokens"])

    schema = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for c, n in zip(kept, names, strict=True)) + "tokens bigint"
    return rows.mapInArrow(run, schema).toDF(*kept, output)
