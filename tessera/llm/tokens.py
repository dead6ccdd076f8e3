"""Token counts of whole texts with a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary; every function takes another path.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts a text before merging bytes.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def encoder(path: str = RANKS):
    """The tokenizer of a rank file, loaded once in each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(documents: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), path: str = RANKS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, keep.., n_tokens): the tokens of each whole text; null texts and null ids are left out."""
    d = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in keep], F.col(text_col).alias("__text")).where("doc_id IS NOT NULL AND __text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=["doc_id", *keep, "n_tokens"])

    return d.mapInArrow(run, "doc_id bigint, " + "".join(f"{c} string, " for c in keep) + "n_tokens bigint")
