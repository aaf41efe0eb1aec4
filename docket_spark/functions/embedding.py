"""Pluggable text embedding: an embedder is a function from texts to vectors, or a column expression."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket_spark.constants import EMBED_BATCH

Embedder = Callable[[Sequence[str]], np.ndarray]
# A term is a run of ASCII letters and digits and of anything beyond ASCII.
_BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TERM = f"[^{_BETWEEN}]+"


@dataclass(frozen=True)
class HashedTerms:
    """Unit vectors of term counts, terms dealt to the dimensions by their MD5; needs no model.

    As a column it stays in built-in expressions; called with texts it gives the same vectors.
    """

    dimensions: int = 64

    def __post_init__(self) -> None:
        if not 1 <= self.dimensions <= 65_536:
            raise ValueError("between 1 and 65536 dimensions")

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        matrix = np.zeros((len(texts), self.dimensions), dtype="float64")
        for row, text in enumerate(texts):
            for term in re.findall(TERM, (text or "").lower()):
                matrix[row, int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dimensions] += 1
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return (matrix / np.where(norms == 0, 1, norms)).astype("float32")

    def column(self, text: Column) -> Column:
        # Split at what is between terms: extracting the terms copies the whole text for each of them.
        parts = F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{_BETWEEN}]+")
        terms = F.array_remove(parts, "")
        number = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % self.dimensions
        # Dimensions as words of five characters in one text: counting one is a replacement in it.
        words = F.transform(terms, lambda x: F.concat(F.lit(" "), F.lpad(F.hex(number(x)), 4, "0")))
        count = lambda all_words, word: (
            F.length(all_words) - F.length(F.replace(all_words, word, F.lit("")))
        ) / 5
        every = F.array(*[F.lit(f" {n:04X}") for n in range(self.dimensions)])
        counts = F.get(
            F.transform(
                F.array(F.array_join(words, "")),
                lambda all_words: F.transform(every, lambda word: count(all_words, word)),
            ),
            F.lit(0),
        )

        def unit(values: Column) -> Column:
            norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x))
            return F.get(
                F.transform(
                    F.array(norm),
                    lambda n: F.transform(values, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float")),
                ),
                F.lit(0),
            )

        return F.get(F.transform(F.array(counts), unit), F.lit(0))


def hashed_terms(dimensions: int = 64) -> HashedTerms:
    return HashedTerms(dimensions)


def with_embedding(
    frame: DataFrame, text: str, embedder: Embedder | HashedTerms, batch: int = EMBED_BATCH
) -> DataFrame:
    """Append an ``embedding`` column; a function sees at most ``batch`` texts at a time.

    Only the text column goes to Python, and none does for an embedder that is a column expression.
    """
    if isinstance(embedder, HashedTerms):
        return frame.withColumn("embedding", embedder.column(F.col(text)))

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = []
            for start in range(0, len(texts), batch):
                part = texts.iloc[start : start + batch].tolist()
                vectors = np.asarray(embedder(part), dtype="float32")
                if len(vectors) != len(part):
                    raise ValueError("the embedder must return one vector per text")
                found += list(vectors)
            yield pd.Series(found, index=texts.index, dtype=object)

    return frame.withColumn("embedding", embed(F.col(text)))
