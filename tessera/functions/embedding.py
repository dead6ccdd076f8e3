"""Vectors of texts by any provider, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring

#: A provider turns texts into a matrix with a row for each.
Provider = Callable[[list[str]], np.ndarray]


def hashed_words(width: int) -> Provider:
    """A provider without a model: the sum of a fixed random unit vector for each word of the text."""

    def run(texts: list[str]) -> np.ndarray:
        memo: dict[str, np.ndarray] = {}
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                if w not in memo:
                    v = np.random.default_rng(xxhash.xxh64_intdigest(w)).standard_normal(width)
                    memo[w] = v / np.linalg.norm(v)
                out[i] += memo[w]
        return out

    return run


def embedded(text: Column, provider: Provider, width: int) -> Column:
    """array<float> of each text; null and blank texts have none. ValueError if a vector has another width."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            there = [i for i, t in enumerate(s) if isinstance(t, str) and t.strip()]
            out: list[list[float] | None] = [None] * len(s)
            if there:
                v = np.asarray(provider([s.iloc[i] for i in there]), np.float32)
                if v.shape != (len(there), width):
                    raise ValueError(f"the provider's vectors are {v.shape[1:]} wide, not {width}")
                for i, x in zip(there, v, strict=True):
                    out[i] = x.tolist()
            yield pd.Series(out)

    return run(text)


def calibration(pairs: DataFrame, provider: Provider, width: int) -> DataFrame:
    """``pairs`` (first, second, label) with their cosine similarity, to look at what a threshold would part."""
    v = pairs.select("label", "first", "second", embedded(F.col("first"), provider, width).alias("a"), embedded(F.col("second"), provider, width).alias("b"))
    return v.select("label", "first", "second", F.round(1 - scoring.cosine_distance(F.col("a"), F.col("b")), 6).alias("similarity"))
