"""Token-bounded chunks and pages of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN, TARGET, MAX = 256, 384, 512
OVERLAP_PCT, TAIL_WORDS, DEPTH = 15, 16, 25
PAGE_TOKENS = 2000
_TOKEN = re.compile(r"\w+|[^\w\s]")
_BLANK = re.compile(r"\n\s*\n+")
_SPACE = re.compile(r"\s")


def count_tokens(text: str) -> int:
    """The plain rule of ``functions.text.token_count``; a tokenizer may be passed in its place."""
    return len(_TOKEN.findall(text))


def halves(text: str, most: int, count: Callable[[str], int], depth: int = 0) -> list[str]:
    """Pieces of at most ``most`` tokens, cut at the white space nearest the middle, or hard if that leaves under a quarter."""
    text = text.strip()
    if not text:
        return []
    if count(text) <= most or depth >= DEPTH or len(text) < 2:
        return [text]
    mid = len(text) // 2
    left = next((mid - k for k in range(mid) if text[mid - k].isspace()), -1)
    right = next((m.start() for m in [_SPACE.search(text, mid)] if m), -1)
    near = min((c for c in (left, right) if c >= 0), key=lambda c: (abs(c - mid), c), default=mid)
    quarter = len(text) / 4
    cut = near if quarter <= near <= len(text) - quarter else mid
    return halves(text[:cut], most, count, depth + 1) + halves(text[cut:], most, count, depth + 1)


def bundle(parts: list[str], target: int, most: int, count: Callable[[str], int]) -> list[str]:
    """Greedy bundles: a part is added if it fits, a bundle closes at ``target``, and an oversize part is cut in halves."""
    out, held, n_held = [], [], 0

    def close() -> None:
        nonlocal held, n_held
        if held:
            out.append("\n\n".join(held))
        held, n_held = [], 0

    for p in parts:
        n = count(p)
        if n > most:
            close()
            out.extend(halves(p, most, count))
            continue
        if n_held and n_held + n > most:
            close()
        held.append(p)
        n_held += n
        if n_held >= target:
            close()
    close()
    return out


def with_overlap(parts: list[str], pct: int, most: int, count: Callable[[str], int]) -> list[str]:
    """Each part led by the last words of the one before it (as it was), as many of up to 16 as fit, two at least."""
    words = min(round(TARGET * pct / 100), TAIL_WORDS)
    out = parts[:1]
    for before, now in zip(parts, parts[1:]):
        tail = before.split()[-words:] if words >= 2 else []
        while len(tail) >= 2 and count(" ".join(tail)) + count(now) > most:
            tail = tail[1:]
        out.append(" ".join(tail) + "\n\n" + now if len(tail) >= 2 else now)
    return out


def chunk(text: str | None, target: int = TARGET, pct: int = OVERLAP_PCT, most: int = MAX, count: Callable[[str], int] = count_tokens) -> list[str]:
    """The chunks of one text; parameters out of range are clamped."""
    target, pct = min(max(target, MIN), MAX), min(max(pct, 0), 50)
    most = max(most, target)
    parts = [p for p in (x.strip() for x in _BLANK.split(text or "")) if p]
    return with_overlap(bundle(parts, target, most, count), pct, most, count)


def paginate(text: str | None, most: int = PAGE_TOKENS, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Pages of whole paragraphs up to ``most`` tokens; an oversize paragraph is a page of its own."""
    out, held, n_held = [], [], 0
    for p in (x.strip() for x in _BLANK.split(text or "")):
        if not p:
            continue
        n = count(p)
        if held and n_held + n > most:
            out.append("\n\n".join(held))
            held, n_held = [], 0
        held.append(p)
        n_held += n
    return [*out, "\n\n".join(held)] if held else out


def _each(texts: DataFrame, keys: list[str], cut: Callable[[str | None], list[str]], place: str) -> DataFrame:
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    names = [f"_k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pieces = [(row, i, t, count_tokens(t)) for row, x in enumerate(pdf["_text"]) for i, t in enumerate(cut(x))]
            out = pd.DataFrame(pieces, columns=["_row", place, "text", "token_count"])
            own = pdf[names].iloc[out["_row"].to_numpy(int)].reset_index(drop=True).set_axis(keys, axis=1)
            yield pd.concat([own, out.drop(columns="_row")], axis=1)

    return texts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("text").alias("_text")).mapInPandas(run, f"{kinds}, {place} int, text string, token_count int")


def chunked(texts: DataFrame, key: str = "doc_id", target: int = TARGET, pct: int = OVERLAP_PCT, most: int = MAX) -> DataFrame:
    """key, chunk_index (from 0), text, token_count of every text's chunks; null and blank texts have none."""
    return _each(texts, [key], lambda t: chunk(t, target, pct, most), "chunk_index")


def region_chunks(regions: DataFrame, keys: list[str], target: int = TARGET, pct: int = OVERLAP_PCT, most: int = MAX) -> DataFrame:
    """The chunks of every region's text, with the region's ``keys`` (its document, page, place and the like)."""
    return _each(regions, keys, lambda t: chunk(t, target, pct, most), "chunk_index")


def paginated(texts: DataFrame, key: str = "doc_id", most: int = PAGE_TOKENS) -> DataFrame:
    """key, page (from 0), text, token_count."""
    return _each(texts, [key], lambda t: paginate(t, most), "page")
