"""Words and paragraphs repaired from scanned pages.

Pages are cut into lines; lines that stand again on page after page are running;
the rest of a page is one character stream without line ends, over which a lattice
of words is decoded jointly: words may be kept, misread, broken by hyphens, split
into pieces or run together, as many as there are. Paragraph boundaries are chosen
by dynamic programming over the page's lines; a paragraph may go on on the next page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.conversations import one_each
from sheafline.operators.ordered import ordered_scan
from sheafline.session import materialize

#: Least vertical distance of two lines' bottoms, and the part of the page below which only footers stand.
LINE_STEP = 8
FOOTER_FROM = 0.85
#: Most pieces of one word.
PIECES = 4

HYPHENS = "-‐‑¬­"
# What a scanner confuses, written as what both sides are reduced to.
_JOIN = [("vv", "w"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("li", "h")]
_CLASS = str.maketrans("0a1i569cfh8z", "oollsbgetbbz")
_EXPAND = {"w": "vv", "m": "rrl", "n": "rl", "d": "el", "u": "ll"}
_YEAR = str.maketrans("oOlIi|BSsbGgqzZ", "001111855669922")
_ROMAN = re.compile(r"^[ivxlcdm]+$")
_STRIP = re.compile(r"^[^\w]+|[^\w]+$")


def plain(token: str) -> str:
    """Lower case without outer punctuation."""
    return _STRIP.sub("", token.strip().strip(HYPHENS)).strip("_").lower()


def reduced(word: str) -> str:
    """The word with all characters that are confused with each other made one."""
    return "".join(_EXPAND.get(c, c) for c in word.lower().translate(_CLASS))


def distance(a: str, b: str, limit: int) -> int:
    """Edit distance, or limit + 1 if it is over the limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


class Lexicon:
    """Known words by spelling and by reduced form; a look-up costs by the token's length, not by the number of words."""

    def __init__(self, words: list[str]) -> None:
        self.words = {w.lower() for w in words if w}
        self.by_form: dict[str, list[str]] = {}
        for w in sorted(self.words):
            self.by_form.setdefault(reduced(w), []).append(w)
        self.letters = sorted({c for w in self.words for c in w})
        self.longest = max(map(len, self.words), default=0)
        self.nearest = lru_cache(maxsize=200_000)(self._nearest)
        self.pieces = lru_cache(maxsize=50_000)(self._pieces)

    def one_edit(self, s: str) -> set[str]:
        """The known words at an edit distance of 1."""
        cuts = [(s[:i], s[i:]) for i in range(len(s) + 1)]
        near = {a + b[1:] for a, b in cuts if b}
        near |= {a + c + b[1:] for a, b in cuts if b for c in self.letters}
        near |= {a + c + b for a, b in cuts for c in self.letters}
        return near & self.words

    def _nearest(self, s: str, loose: bool) -> str | None:
        """The known word that ``s`` stands for; None if none does."""
        if s in self.words:
            return s
        if len(s) < 2:
            return None
        found = list(self.by_form.get(reduced(s), ()))
        for i, c in enumerate(s):  # h for li, and the reverse
            if c == "h":
                found += self.by_form.get(reduced(s[:i] + "li" + s[i + 1 :]), ())
            elif s.startswith("li", i):
                found += self.by_form.get(reduced(s[:i] + "h" + s[i + 2 :]), ())
        if found:
            return min(found, key=lambda w: (distance(s, w, 6), w))
        if loose and len(s) >= 6:
            near = self.one_edit(s)
            if len(near) == 1:
                return near.pop()
        return None

    def _pieces(self, s: str) -> tuple[str, ...] | None:
        """The fewest known words of two letters or more that ``s`` consists of; None if it doesn't."""
        best: list[tuple[str, ...] | None] = [()] + [None] * len(s)
        for j in range(2, len(s) + 1):
            for i in range(max(0, j - self.longest), j - 1):
                if best[i] is not None and s[i:j] in self.words and (best[j] is None or len(best[i]) + 1 < len(best[j])):
                    best[j] = (*best[i], s[i:j])
        return best[-1]


def year_of(s: str) -> str | None:
    """A four-digit year read with letters for digits; None if it isn't one or holds digits only."""
    if len(s) == 4 and not s.isdigit() and any(c.isdigit() for c in s):
        y = s.translate(_YEAR)
        if y.isdigit() and 1800 <= int(y) <= 2099:
            return y
    return None


def running_key(tokens: list[str]) -> str:
    """What a running line has in common with its repeats: reduced words, numbers as #."""
    out = []
    for t in tokens:
        p = plain(t)
        if p:
            out.append("#" if p.translate(_YEAR).isdigit() or _ROMAN.match(p) and len(p) <= 6 else reduced(p))
    return " ".join(out)


_PAGE = (
    "doc_id string, page int, lines array<struct<ids: array<bigint>, tokens: array<string>, y1: int, y2: int, x1: int, x2: int, key: string>>, height int"
)


def pages_of_words(words: DataFrame) -> DataFrame:
    """One row per page with its lines in reading order. A page is what one task holds, never a document.

    A word delivered again stands on the same page, where it counts once.
    """
    slim = words.select("word_id", "doc_id", "page", "text", "x1", "y1", "x2", "y2", "page_height").where("word_id is not null and text is not null")
    slim = slim.na.fill(0, ["x1", "y1", "x2", "y2", "page"]).na.fill(1000, ["page_height"])

    def page(rows: list[tuple]) -> tuple:
        lines: list[list] = []
        seen: set[int] = set()
        for r in rows:  # in order of y2
            if r[0] in seen:
                continue
            seen.add(r[0])
            if lines and r[7] - lines[-1][-1][7] < LINE_STEP:
                lines[-1].append(r)
            else:
                lines.append([r])
        out = []
        for ln in lines:
            ln.sort(key=lambda r: (r[4], r[0]))
            tokens = [r[3] for r in ln]
            out.append({"ids": [r[0] for r in ln], "tokens": tokens, "y1": min(r[5] for r in ln), "y2": max(r[7] for r in ln), "x1": ln[0][4], "x2": max(r[6] for r in ln), "key": running_key(tokens)})
        return rows[0][1], rows[0][2], out, rows[0][8]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["word_id", "doc_id", "page", "text", "x1", "y1", "x2", "y2", "page_height"]
        open_: list[tuple] = []
        for pdf in batches:
            done = []
            for r in zip(*[pdf[c].tolist() for c in cols]):
                if open_ and (r[1], r[2]) != (open_[0][1], open_[0][2]):
                    done.append(page(open_))
                    open_ = []
                open_.append(r)
            if done:
                yield pd.DataFrame(done, columns=["doc_id", "page", "lines", "height"])
        if open_:
            yield pd.DataFrame([page(open_)], columns=["doc_id", "page", "lines", "height"])

    return slim.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "y2", "x1", "word_id").mapInPandas(run, _PAGE)


def pages_of_regions(regions: DataFrame) -> DataFrame:
    """The same from ``ocr_regions``: a region's lines share its box and its id."""
    one = one_each(regions.select("region_id", "doc_id", "page", "reading_order", "text", "x1", "y1", "x2", "y2").where("region_id is not null and text is not null"), "region_id")
    one = one.na.fill(0, ["x1", "y1", "x2", "y2", "page", "reading_order"])

    def page(rows: list[tuple]) -> tuple:
        out = []
        for rid, _, _, _, text, x1, y1, x2, y2 in rows:
            parts = [ln.split() for ln in text.split("\n")]
            parts = [p for p in parts if p]
            step = (y2 - y1) / max(1, len(parts))
            for k, tokens in enumerate(parts):
                out.append({"ids": [rid] * len(tokens), "tokens": tokens, "y1": int(y1 + k * step), "y2": int(y1 + (k + 1) * step), "x1": x1, "x2": x2, "key": running_key(tokens)})
        return rows[0][1], rows[0][2], out, 1000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["region_id", "doc_id", "page", "reading_order", "text", "x1", "y1", "x2", "y2"]
        open_: list[tuple] = []
        for pdf in batches:
            done = []
            for r in zip(*[pdf[c].tolist() for c in cols]):
                if open_ and (r[1], r[2]) != (open_[0][1], open_[0][2]):
                    done.append(page(open_))
                    open_ = []
                open_.append(r)
            if done:
                yield pd.DataFrame(done, columns=["doc_id", "page", "lines", "height"])
        if open_:
            yield pd.DataFrame([page(open_)], columns=["doc_id", "page", "lines", "height"])

    return one.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "reading_order", "y1", "region_id").mapInPandas(run, _PAGE)


def with_running(pages: DataFrame) -> DataFrame:
    """Add top and bottom, how many lines at the page's ends are running, and after and before, the body words next to the page's.

    A last line far down the page is a footer. A first line is a header if its key
    (numbers and confused characters aside) heads another page of the document,
    or if the document has such headers and this line stands where they do, apart
    from the text below. The counts are combined before they are shuffled, and only
    the ends of pages are: their lines are joined back once.
    """
    n = F.size("lines")
    head, second = F.col("lines")[0], F.try_element_at("lines", F.lit(2))
    last = F.element_at("lines", -1)
    gap = F.coalesce(second["y2"] - head["y2"], F.lit(1000))
    bottom = ((last["y1"] > FOOTER_FROM * F.col("height")) & (n > 1)).cast("int")
    word = lambda line, at: F.try_element_at(F.try_element_at("lines", line)["tokens"], F.lit(at))
    ends = [word(F.lit(1), 1).alias("w1"), word(F.lit(2), 1).alias("w2"), word(-1 - bottom, -1).alias("w_last")]
    p = pages.where(n > 0).select("doc_id", "page", n.alias("n"), head["key"].alias("head"), head["y1"].alias("head_y"), gap.alias("gap"), bottom.alias("bottom"), *ends)
    repeats = p.where("head <> '' and gap > 24").groupBy("doc_id", "head").agg(F.count("*").alias("times"), F.min("head_y").alias("low"), F.max("head_y").alias("high")).where("times > 1")
    docs = repeats.groupBy("doc_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    p = p.join(repeats.select("doc_id", "head", F.lit(True).alias("again")), ["doc_id", "head"], "left").join(docs, "doc_id", "left")
    placed = (F.col("gap") > 24) & (F.col("head_y") >= F.col("low") - 6) & (F.col("head_y") <= F.col("high") + 6)
    top = F.when((F.coalesce("again", F.lit(False)) & (F.col("gap") > 24)) | F.coalesce(placed, F.lit(False)), 1).otherwise(0)
    p = p.select("doc_id", "page", "n", top.alias("top"), "bottom", "w1", "w2", "w_last")
    body = F.col("n") - F.col("bottom") > F.col("top")
    first = F.when(body, F.when(F.col("top") == 1, F.col("w2")).otherwise(F.col("w1")))
    p = p.select("doc_id", "page", "top", "bottom", F.struct("page", first.alias("word")).alias("first"), F.struct("page", F.when(body, F.col("w_last")).alias("word")).alias("last"))
    p = ordered_scan(p, ["doc_id"], ["page"], prevs={"_before": F.col("last")}, nexts={"_after": F.col("first")})
    after = F.when(F.col("_after.page") == F.col("page") + 1, F.col("_after.word"))
    before = F.when(F.col("_before.page") == F.col("page") - 1, F.col("_before.word"))
    p = p.select(F.col("doc_id").alias("d"), F.col("page").alias("q"), "top", "bottom", after.alias("after"), before.alias("before"))
    return pages.join(p, pages["doc_id"].eqNullSafe(p["d"]) & (pages["page"] == p["q"])).drop("d", "q")


def decode(tokens: list[str], ends: list[bool], lex: Lexicon) -> list[tuple[str, str]]:
    """(kind, word) per token of a stream: the cheapest way through the lattice of words over its characters.

    kind: keep, misread, hyphen (first part), rest (other parts), split (first
    piece), merged. ``ends`` tells where a line ends. A word of the lattice covers one
    token, several (with or without hyphens at line ends, ``PIECES`` at most), or a part
    of one. Costs: known word 0, misread 1, word broken at a line's end -0.5 (misread
    0.7), split word 1 for each cut, words run together 2.4 and 0.3 each, unknown 4.
    """
    n = len(tokens)
    best, back = [0.0] + [1e9] * n, [None] * (n + 1)
    plains = [plain(t) for t in tokens]
    for i in range(n):
        t, s = tokens[i], plains[i]
        ways = []
        if not any(c.isalpha() for c in s):
            ways.append((0.0, 1, [("keep", s)]))
        else:
            known = lex.nearest(s, t[:1].islower() or t[:1].isdigit())
            year = year_of(_STRIP.sub("", t))
            ways.append((4.0, 1, [("keep", s)]))
            if s in lex.words:
                ways.append((0.0, 1, [("keep", s)]))
            elif year:
                ways.append((0.5, 1, [("misread", year)]))
            elif known:
                ways.append((1.0, 1, [("misread", known)]))
            elif pieces := lex.pieces(s):
                ways.append((2.4 + 0.3 * len(pieces), 1, [("merged", " ".join(pieces))]))
            if ends[i] and t.rstrip()[-1:] in HYPHENS and i + 1 < n:
                ways += broken(tokens, plains, ends, i, lex)
            elif s not in lex.words and t[-1:].isalnum():
                joined = s
                for j in range(i + 1, min(n, i + PIECES)):
                    if not plains[j] or plains[j] in lex.words and j == i + 1:
                        break
                    joined += plains[j]
                    if joined in lex.words:
                        ways.append((float(j - i), j - i + 1, [("split", joined)] + [("rest", "")] * (j - i)))
                    if not tokens[j][-1:].isalnum():
                        break
        for cost, step, kinds in ways:
            if best[i] + cost < best[i + step]:
                best[i + step], back[i + step] = best[i] + cost, (i, kinds)
    out: list[tuple[str, str]] = []
    j = n
    while j:
        j, kinds = back[j]
        out[:0] = kinds
    return out


def broken(tokens: list[str], plains: list[str], ends: list[bool], i: int, lex: Lexicon) -> list[tuple]:
    """Ways to read a word from token i on, which ends a line with a hyphen; further parts may end so too."""
    ways, parts = [], [_STRIP.sub("", tokens[i].strip().rstrip(HYPHENS).lower())]
    for j in range(i + 1, min(len(tokens), i + PIECES)):
        if not plains[j]:
            break
        parts.append(plains[j])
        for joined in ("".join(parts), "-".join(parts)):
            if whole := lex.nearest(joined, True):
                ways.append((-0.5 if whole == joined else 0.7, j - i + 1, [("hyphen", whole)] + [("rest", "")] * (j - i)))
        if not (ends[j] and tokens[j].rstrip()[-1:] in HYPHENS):
            break
    return ways


def paragraphs(lines: list[dict]) -> list[int]:
    """The paragraph number of each line: boundaries of least total cost.

    A boundary costs 2; to join two lines costs by the gap over the usual step, a
    sentence end before a short line's end, and a capital after it.
    """
    if not lines:
        return []
    steps = sorted(b["y2"] - a["y2"] for a, b in zip(lines, lines[1:]))
    usual = max(1, steps[len(steps) // 4]) if steps else 1
    width = max(ln["x2"] for ln in lines)
    cost, choice = [0.0, 1e9], []
    for a, b in zip(lines, lines[1:]):
        gap = max(0.0, (b["y2"] - a["y2"]) / usual - 1.25) * 4
        ended = a["tokens"][-1][-1:] in ".!?:;"
        short = a["x2"] < 0.75 * width
        join = gap + (0.8 if ended and short else 0.0) + (0.5 if ended and b["tokens"][0][:1].isupper() else 0.0)
        here = [0 if cost[0] <= cost[1] else 1] * 2
        low = min(cost)
        choice.append(here)
        cost = [low + join, low + 2.0]
    j = 0 if cost[0] <= cost[1] else 1
    marks = []
    for here in reversed(choice):
        marks.append(j)
        j = here[j]
    out, at = [0], 0
    for m in reversed(marks):
        at += m
        out.append(at)
    return out


def lexicon_words(known: DataFrame) -> list[str]:
    """The known words: a spelling dictionary, of which every task holds a copy (some hundred bytes a word)."""
    return [r["word"] for r in known.where("word is not null").select("word").distinct().toLocalIterator()]


def repairs(pages: DataFrame, words: list[str]) -> DataFrame:
    """Every token as decoded: doc_id, page, word_id, no (in the page), paragraph, kind, raw, repaired, goes_on.

    goes_on: whether the page's first paragraph goes on from the page before: that one
    ends within a sentence or a word, and this one begins in lower case.
    """

    share = pages.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(share.value)
        names = ["doc_id", "page", "word_id", "no", "paragraph", "kind", "raw", "repaired", "goes_on"]
        for pdf in batches:
            rows = []
            for doc, page, lines, top, bottom, after, before in zip(pdf["doc_id"], pdf["page"], pdf["lines"], pdf["top"], pdf["bottom"], pdf["after"], pdf["before"]):
                body = list(lines)[top : len(lines) - bottom]
                at = 0
                for ln in [*list(lines)[:top], *list(lines)[len(lines) - bottom :]]:
                    for i, t in zip(ln["ids"], ln["tokens"]):
                        rows.append((doc, page, i, -1, -1, "running", t, "", False))
                body = [{**ln, "tokens": list(ln["tokens"]), "ids": list(ln["ids"])} for ln in body]
                tokens = [t for ln in body for t in ln["tokens"]]
                ids = [i for ln in body for i in ln["ids"]]
                ends = [k == len(ln["tokens"]) - 1 for ln in body for k in range(len(ln["tokens"]))]
                lead = bool(before) and before.rstrip()[-1:] in HYPHENS and len(before.strip(HYPHENS + " ")) > 0
                stream = ([before] if lead else []) + tokens + ([after] if after else [])
                read = decode(stream, ([True] if lead else []) + ends + ([True] if after else []), lex)
                read = read[lead : lead + len(tokens)]
                on = bool(before) and bool(tokens) and before.rstrip()[-1:] not in ".!?:;" and tokens[0][:1].islower()
                paras = [p for ln, p in zip(body, paragraphs(body)) for _ in ln["tokens"]]
                for i, t, p, (kind, word) in zip(ids, tokens, paras, read):
                    rows.append((doc, page, i, at, p, kind, t, word, on))
                    at += 1
            yield pd.DataFrame(rows, columns=names)

    schema = "doc_id string, page int, word_id long, no int, paragraph int, kind string, raw string, repaired string, goes_on boolean"
    return pages.select("doc_id", "page", "lines", "top", "bottom", "after", "before").mapInPandas(run, schema)


def found(words: DataFrame, known: DataFrame) -> DataFrame:
    """p7_found: words to be changed, with their kind and repaired form."""
    out = repairs(with_running(materialize(pages_of_words(words))), lexicon_words(known))
    return out.where("kind in ('running', 'hyphen', 'misread')").select("word_id", "kind", "repaired").distinct()


def repaired_paragraphs(regions: DataFrame, known: DataFrame) -> DataFrame:
    """Continuous paragraphs of ``ocr_regions``: doc_id, paragraph (from 1), page and last_page (where it begins and ends), text.

    Running lines are left out, broken words whole, misread words right; words keep
    their outer punctuation and first capital. A paragraph is one task's at most.
    """
    out = repairs(with_running(materialize(pages_of_regions(regions))), lexicon_words(known)).where("kind <> 'running' and kind <> 'rest'")
    lead = F.regexp_extract("raw", r"^[^\p{L}\p{N}]*", 0)
    tail = F.regexp_extract("raw", r"[^\p{L}\p{N}]*$", 0)
    capital = F.col("raw").rlike(r"^[^\p{L}\p{N}]*\p{Lu}")
    fixed = F.when(capital, F.concat(F.upper(F.substring("repaired", 1, 1)), F.expr("substring(repaired, 2)"))).otherwise(F.col("repaired"))
    word = F.when(F.col("kind") == "keep", F.col("raw")).when(F.col("kind").isin("hyphen", "split"), F.concat(lead, fixed)).otherwise(F.concat(lead, fixed, tail))
    parts = out.select("doc_id", "page", "paragraph", "no", word.alias("word"), "goes_on").groupBy("doc_id", "page", "paragraph").agg(F.sort_array(F.collect_list(F.struct("no", "word"))).alias("w"), F.first("goes_on").alias("goes_on"))
    parts = materialize(parts.select("doc_id", "page", F.col("paragraph").alias("part"), F.array_join(F.col("w.word"), " ").alias("text"), (~((F.col("paragraph") == 0) & F.col("goes_on"))).cast("long").alias("new")))
    placed = ordered_scan(parts, ["doc_id"], ["page", "part"], sums={"paragraph": F.col("new")})
    whole = placed.groupBy("doc_id", "paragraph").agg(F.min("page").alias("page"), F.max("page").alias("last_page"), F.sort_array(F.collect_list(F.struct("page", "part", "text"))).alias("t"))
    return whole.select("doc_id", "paragraph", "page", "last_page", F.array_join(F.col("t.text"), " ").alias("text"))
