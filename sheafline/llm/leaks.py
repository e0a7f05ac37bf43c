"""Evaluation passages in training documents.

Windows of words are embedded by the CGK random walk, which turns edit distance
into Hamming distance; repeated bit sampling of the embedding gives LSH keys, by
which document windows meet item windows. Around each meeting the words are then
aligned: the longest run in common and a banded edit distance decide.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.lookalike import INVISIBLE, letter_table
from sheafline.session import materialize

#: Consecutive words in common that make a leak, and the edits that a passage of so many words may have.
MIN_WORDS = 20
MAX_EDITS = 3
#: Words of a window, and how far apart a document's windows begin: a passage of MIN_WORDS holds four or more.
WINDOW = 12
STRIDE = 2
#: Repetitions, and positions of the embedding sampled by each.
REPEATS = 8
BITS = 8
#: Bits of the map of item keys by which tasks drop windows that meet nothing; its size doesn't follow the data.
FILTER_BITS = 26

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_MASK = (1 << 64) - 1


def _letters() -> dict[int, str | None]:
    return {ord(k): v for k, v in letter_table().items()} | {ord(c): None for c in INVISIBLE}


def words_of(text: str | None, letters: dict[int, str | None]) -> list[str]:
    """The words of a text: lower case, one form per visible letter, without tags and invisible characters."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFC", text.translate(letters))).translate(letters)
    return _WORD.findall(text.lower())


def word_hash(word: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(word)
    return h if h & 0xFFFFFFFF else h + 1  # 0 stands for no word


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def cgk_keys(h: np.ndarray, places: np.ndarray, window: int, repeats: int, bits: int, seed: int = 11) -> np.ndarray:
    """LSH keys (places x repeats) of the windows' CGK embeddings.

    The walk over 3 x window steps writes the symbol it stands at and moves on if
    the symbol's random bit of that step is 1; past the end it writes padding.
    """
    rng = np.random.default_rng(seed)
    steps = 3 * window
    sampled = np.sort(np.stack([rng.choice(2 * window, size=bits, replace=False) for _ in range(repeats)]), axis=1)
    coins = _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))
    keys = np.full((len(places), repeats), 0, np.uint64)
    keys += np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)
    at, end = places.copy(), places + window
    for j in range(min(steps, int(sampled.max()) + 1)):
        inside = at < end
        here = np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(0))
        for r in range(repeats):
            if j in sampled[r]:
                keys[:, r] = _mix(keys[:, r] * np.uint64(0x9E3779B97F4A7C15) + here)
        at += inside & ((coins[np.minimum(at, len(h) - 1)] >> np.uint64(j)) & np.uint64(1)).astype(bool)
    return keys


def key_map(keys: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, those of the keys set. A row per 64 bits reaches the driver, so their number is bounded."""
    slot = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)
    words = keys.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def window_keys(texts: DataFrame, key: str, stride: int, known: np.ndarray | None = None, min_words: int = MIN_WORDS, window: int = WINDOW, repeats: int = REPEATS, bits: int = BITS) -> DataFrame:
    """One row (id, key, around) per window and repetition; around: 32-bit hashes of the words that an alignment could cover.

    Windows begin ``stride`` words apart in each text. ``known`` is a map of keys; windows none of whose keys are in it are left out.
    """
    side = min_words - window + MAX_EDITS
    share = None if known is None else texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, seen = _letters(), {}
        for pdf in batches:
            flat: list[int] = []
            starts, sizes, ids = [], [], []
            for i, t in zip(pdf["id"], pdf["text"]):
                w = words_of(t, letters)
                if len(w) < min_words:
                    continue
                flat.extend([0] * side)
                starts.append(len(flat))
                sizes.append(len(w))
                ids.append(i)
                for x in w:
                    v = seen.get(x)
                    if v is None:
                        v = seen[x] = word_hash(x)
                    flat.append(v)
            if len(seen) > 2_000_000:
                seen.clear()
            if not ids:
                continue
            flat.extend([0] * (side + window))
            h = np.array(flat, np.uint64)
            n = (np.array(sizes) - window) // stride + 1
            owner = np.repeat(np.arange(len(ids)), n)
            places = np.array(starts)[owner] + stride * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
            keys = cgk_keys(h, places, window, repeats, bits)
            if share is not None:
                slot = keys & np.uint64((1 << FILTER_BITS) - 1)
                row, column = np.nonzero((share.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
            else:
                row, column = np.divmod(np.arange(keys.size), repeats)
            signed = h.astype(np.uint32).view(np.int32)
            width = window + 2 * side
            some, back = np.unique(row, return_inverse=True)  # a window is cut out once, however many of its keys are known
            cut = signed[(places[some] - side)[:, None] + np.arange(width)].tobytes()
            around = np.array([cut[i : i + 4 * width] for i in range(0, len(cut), 4 * width)], dtype=object)
            yield pd.DataFrame({"id": pd.Series(ids).iloc[owner[row]].to_numpy(), "key": keys[row, column].view(np.int64), "around": around[back]})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("id"), "text").where("text is not null").mapInPandas(run, f"id {kind}, key long, around binary")


def longest_run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The longest run of equal words at equal places, row by row; 0 stands for no word."""
    run, best = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for j in range(a.shape[1]):
        run = np.where((a[:, j] == b[:, j]) & (a[:, j] != 0), run + 1, 0)
        best = np.maximum(best, run)
    return best


def could_hold(text: np.ndarray, item: np.ndarray, size: int, edits: int) -> np.ndarray:
    """Whether some ``size`` words of the item have all but ``edits`` of them near the same place of the text, row by row."""
    near = np.zeros(item.shape, bool)
    for d in range(-edits, edits + 1):
        lo, hi = max(0, -d), item.shape[1] - max(0, d)
        near[:, lo:hi] |= item[:, lo:hi] == text[:, lo + d : hi + d]
    near &= item != 0
    sums = np.cumsum(np.pad(near, ((0, 0), (1, 0))), axis=1)
    return (sums[:, size:] - sums[:, :-size]).max(axis=1) >= size - edits


def edit_distance(passage: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The least word edits that turn each passage into a part of its text, which is 2 x MAX_EDITS words longer.

    Banded: the part may begin, and the alignment drift, up to MAX_EDITS words to either side.
    """
    band = text.shape[1] - passage.shape[1] + 1
    last = np.zeros((len(passage), band), np.int64)
    for i in range(passage.shape[1]):
        word = passage[:, i]
        now = last + ((text[:, i : i + band] != word[:, None]) | (word == 0)[:, None])
        now[:, :-1] = np.minimum(now[:, :-1], last[:, 1:] + 1)
        for d in range(1, band):
            now[:, d] = np.minimum(now[:, d], now[:, d - 1] + 1)
        last = now
    return last.min(axis=1)


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS) -> DataFrame:
    """doc_id, item_id, run, edits of documents that hold a passage of an item, as it stands or edited.

    run: the longest run of words in common around a meeting of windows (min_words
    or more where the passage stands unchanged); edits: the least word edits between
    ``min_words`` words of the item and a part of the document. A pair is listed if the
    run is ``min_words`` or more, which no pair escapes, or the edits are ``max_edits``
    or fewer (found with the recall of the sampling). Each pair once. Null, blank and
    shorter texts match nothing.
    """
    asked = materialize(window_keys(items, "item_id", 1, min_words=min_words).withColumnRenamed("id", "item_id"))
    met = window_keys(documents, "doc_id", STRIDE, known=key_map(asked.select("key")), min_words=min_words).withColumnRenamed("id", "doc_id")
    pairs = met.withColumnRenamed("around", "a").join(asked.withColumnRenamed("around", "b"), "key").select("doc_id", "item_id", "a", "b")
    slack = min_words - WINDOW

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            a, b = (np.frombuffer(b"".join(pdf[c]), np.int32).reshape(len(pdf), -1) for c in ("a", "b"))
            kept = could_hold(a, b, min_words, max_edits)
            a, b, pdf = a[kept], b[kept], pdf[kept]
            edits = np.full(len(a), min_words, np.int64)
            for d in range(slack + 1):  # every passage of the item that holds the window
                at = MAX_EDITS + d
                part = b[:, at : at + min_words]
                got = edit_distance(part, a[:, at - MAX_EDITS : at + min_words + MAX_EDITS])
                edits = np.minimum(edits, np.where((part != 0).all(axis=1), got, min_words))
            out = pdf[["doc_id", "item_id"]].assign(run=longest_run(a, b), edits=edits)
            yield out.groupby(["doc_id", "item_id"], as_index=False).agg({"run": "max", "edits": "min"})

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("doc_id", "item_id"))
    each = pairs.mapInPandas(verify, f"{kinds}, run long, edits long").groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.min("edits").alias("edits"))
    return each.where((F.col("run") >= min_words) | (F.col("edits") <= max_edits))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p8_found: pairs with ``MIN_WORDS`` or more consecutive words in common."""
    return leaks(documents, items).where(F.col("run") >= MIN_WORDS).select("doc_id", "item_id")
