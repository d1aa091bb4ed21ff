"""Embedding models behind one interface; one that hashes words stands in where no model is at hand."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One unit vector of ``dim`` float32 per text."""


class HashingEmbedder:
    """Signed hashes of words, added up and normalised: the same words, the same vector. Wordless texts give zeros."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for w in re.findall(r"[^\W_]+", text.lower()):
                digest = hashlib.blake2b(w.encode(), digest_size=16).digest()
                for i in range(0, 16, 4):  # several places, so that two words seldom cancel each other
                    h = int.from_bytes(digest[i : i + 4], "little")
                    row[(h >> 1) % self.dim] += 1 if h & 1 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def embedded(text: Column, embedder: Embedder) -> Column:
    """The vector of each text; a null text counts as empty. The embedder is set up once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed([t or "" for t in texts])))

    return run(text)
