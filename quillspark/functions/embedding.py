"""Embedders and rerankers as pluggable columns, with offline defaults."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"\w+")


def hash_features(text: str) -> list[str]:
    """Lower-cased words, each with its letter pairs and triples."""
    features = []
    for word in WORD.findall(text.lower()):
        features.append(word)
        for n in (2, 3):
            features += [word[i : i + n] for i in range(len(word) - n + 1)]
    return features


#: Digests that are kept between texts. Frequent features come back at once after the store is emptied.
MOST_KNOWN = 100_000


def hash_embedding(text: str | None, size: int = 384, known: dict[str, int] | None = None) -> list[float]:
    """Feature hashing: the digest's remainder names the place and its top bit the sign; length one, or zero without words.

    known keeps the digests of features between calls; it is emptied when it holds many.
    """
    return _hash_vector(text, size, {} if known is None else known).tolist()


def _hash_vector(text: str | None, size: int, known: dict[str, int]) -> np.ndarray:
    features = hash_features(text or "")
    values = np.fromiter((_digest(f, known) for f in features), np.uint64, len(features))
    signs = np.where(values >> np.uint64(63), -1.0, 1.0)
    vector = np.bincount((values % np.uint64(size)).astype(np.int64), weights=signs, minlength=size)
    norm = float(np.sqrt(vector @ vector))
    return vector / norm if norm else vector


def _digest(feature: str, known: dict[str, int]) -> int:
    found = known.get(feature)
    if found is None:
        if len(known) >= MOST_KNOWN:
            known.clear()
        found = known[feature] = int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "little")
    return found


def load_hash_embedding() -> Callable[[list[str]], list]:
    known: dict[str, int] = {}
    return lambda texts: [_hash_vector(t, 384, known) for t in texts]


def embedder(load: Callable[[], Callable[[list[str]], list]], batch: int = 64) -> Callable[[Column], Column]:
    """A column function for a model: load() runs once in each task and gives texts -> vectors."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            texts = texts.fillna("")
            yield pd.Series([np.asarray(v, np.float64) for at in range(0, len(texts), batch) for v in model(list(texts[at : at + batch]))], dtype="object")

    return embed


hash_embedder = embedder(load_hash_embedding)


def reranker(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A column function for a pair scorer; where load() fails scores are null, and retrieval goes on without it."""

    @F.pandas_udf(T.DoubleType())
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # noqa: BLE001 a missing model is a mode of operation
            model = None
        for questions, texts in parts:
            yield pd.Series([None] * len(texts) if model is None else model(list(zip(questions, texts, strict=True))), dtype="float64")

    return score


def keyword_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that the text has; the offline reranker."""
    words = F.array_distinct(F.filter(F.split(F.lower(question), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    held = F.size(F.array_intersect(words, F.split(F.lower(text), r"[^\p{L}\p{N}_]+")))
    return F.coalesce(F.try_divide(held.cast("double"), F.size(words).cast("double")), F.lit(0.0))


def normalise(vector: Column) -> Column:
    """A vector of length one; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
