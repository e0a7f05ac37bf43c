"""Answers over search results: the loop around an injected language model."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from sheafline.operators.search import CHAT_TOP_K, search

MAX_ITERATIONS = 4
_MARK = re.compile(r"(?<![\w\]])\[(\d+)\]")


def context(passages: list[Any], start: int = 1) -> str:
    """Passages numbered from ``start``."""
    return "\n\n".join(f"[{i}] ({p['doc_title']}, p. {p['page']})\n{p['text']}" for i, p in enumerate(passages, start))


def finalize(reply: str, n: int) -> dict[str, Any]:
    """The reply without citations outside 1..n, what it cites in order of appearance, and what was taken out."""
    numbers = [int(x) for x in _MARK.findall(reply)]
    invalid = sorted({x for x in numbers if not 1 <= x <= n})
    if invalid:
        reply = _MARK.sub(lambda m: m[0] if 1 <= int(m[1]) <= n else "", reply)
        reply = re.sub(r"\s+([.,;:!?])", r"\1", re.sub(r"[ \t]{2,}", " ", reply)).strip()
    return {"answer": reply, "cited": list(dict.fromkeys(x for x in numbers if 1 <= x <= n)), "invalid": invalid}


def answer(chunks: DataFrame, question: str, model: Callable[[str, str], dict[str, Any]], top_k: int = CHAT_TOP_K, iterations: int = MAX_ITERATIONS) -> dict[str, Any]:
    """Ask a model that may search.

    ``model(question, context)`` returns {"search": query} or {"answer": text}; after
    ``iterations`` searches it is asked once more and must answer. Each search is one
    Spark job and brings back ``top_k`` rows; citation numbers run on over searches.
    """
    found: list[Any] = []
    for i in range(iterations + 1):
        step = model(question, context(found))
        if "answer" in step or i == iterations:
            return finalize(str(step.get("answer", "")), len(found)) | {"passages": found}
        known = {p["chunk_id"] for p in found}
        found.extend(r.asDict() for r in search(chunks, str(step["search"]), top_k=top_k).collect() if r["chunk_id"] not in known)
    raise AssertionError("unreachable")
