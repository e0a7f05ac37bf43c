"""Where models plug in.

A hook maps a column of texts (or other payloads) to a column of results, a batch
at a time; the model is made once per worker. Built-in rules stand in by default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
DIM = 384


def batched(make: Callable[[], Callable[[list], list]], returns: str | T.DataType, batch: int = 32) -> Callable[[Column], Column]:
    """A Column function of a model. ``make`` builds the model in the worker; it gets lists of up to ``batch`` values."""

    @F.pandas_udf(returns)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in series:
            values, out = s.tolist(), []
            for i in range(0, len(values), batch):
                out.extend(model(values[i : i + batch]))
            yield pd.Series(out, dtype=object) if len(out) == 0 or isinstance(out[0], (list, np.ndarray)) else pd.Series(out)

    return run


def hashed_vectors(dim: int = DIM, prefix: str = "") -> Callable[[list], list]:
    """The default embedder: signed hashed counts of words and word pairs, of unit length. Texts without a word give zeros, with a prefix too."""
    import re

    import xxhash

    word = re.compile(r"\w+")

    def embed(texts: list) -> list:
        out = []
        for t in texts:
            v = np.zeros(dim, np.float64)
            w = word.findall((prefix + t).lower()) if t and word.search(t) else []
            for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]:
                h = xxhash.xxh64_intdigest(x)
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = float(np.sqrt((v * v).sum()))
            out.append([round(float(x), 6) for x in (v / n if n else v)])
        return out

    return embed


def embedded(rows: DataFrame, text: str = "text", make: Callable[[], Callable[[list], list]] | None = None, dim: int = DIM, prefix: str = QUERY_PREFIX) -> DataFrame:
    """Rows with ``embedding`` by a hook, or by hashed counts; ``prefix`` stands before every text."""
    return rows.withColumn("embedding", batched(make or (lambda: hashed_vectors(dim, prefix)), "array<double>")(F.col(text)))


def query_vector(query: str, dim: int = DIM, prefix: str = QUERY_PREFIX) -> list[float]:
    """The default embedding of a query."""
    return hashed_vectors(dim, prefix)([query])[0]


def query_vector_or_reason(query: str, make: Callable[[], Callable[[list], list]] | None = None, dim: int = DIM) -> tuple[list[float] | None, str | None]:
    """(vector, None) of a query, or (None, reason) where it is blank, the model fails or gives nothing."""
    if not query or not query.strip():
        return None, "blank query"
    try:
        vector = make()([query])[0] if make else query_vector(query, dim)
    except Exception as e:  # noqa: BLE001 - search goes on by words
        return None, f"{type(e).__name__}: {e}"[:500]
    return (vector, None) if len(vector) and any(vector) else (None, "empty vector")
