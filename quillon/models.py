"""Pluggable models: an embedder and a generator, run over Arrow batches.

No pretrained model is needed: the default embedder hashes tokens, and the
default generator gives a fixed text. Any callable with the same shape fits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
Generator = Callable[[list[str]], list[str]]


def hashed_embedder(dims: int = 256) -> Embedder:
    """Counts of tokens by hash, each with a sign, of unit length (zero for no tokens)."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in re.findall(r"[a-z0-9_]+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                row[h % dims] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed(c: Column, model: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def of(s: pd.Series) -> pd.Series:
        return pd.Series(list(model(s.fillna("").tolist())))

    return of(c)


def constant_generator(text: str) -> Generator:
    return lambda prompts: [text] * len(prompts)


def generate(c: Column, model: Generator) -> Column:
    """What the model says to each prompt; null where there is none: the model isn't asked."""

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        out, held = pd.Series([None] * len(s), dtype=object), s.notna().to_numpy()
        if held.any():
            out[held] = model(s[held].tolist())
        return out

    return of(c)
