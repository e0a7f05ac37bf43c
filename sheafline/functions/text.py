"""Text functions as Column expressions, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no intent, and technical terms that always count.
STOPWORDS = (
    "a an and are as at be by for from has have i in is it its of on or show tell that the their them these they this to us was we "
    "what when where which who why with you your me my give about find list all any only some"
).split()
TECH_TERMS = "ai ml dl rl nlp cv rag llm vae gan bert gpt gpu cpu ram hbm ssd nic vpn gdp ct mri xr dna rna crispr ph".split()
#: Publisher boilerplate, matched without case.
BOILERPLATE = [
    r"\bgoogle\s+hereby\s+grants?\s+permissions?\b",
    r"\bgoogleherebygrantspermission(?:to)?\b",
    r"\bgoogle\s*brain\b",
    r"\bgoogle\s*research\b",
    r"\bmountain\s+view\b",
    r"\bcopyright\s+\(c\)\s*\d{4}\b",
]
KEYWORD = r"[A-Za-z0-9][A-Za-z0-9-]*[A-Za-z0-9]|[A-Za-z0-9]"


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def none_if_blank(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def keywords(text: Column) -> Column:
    """Distinct keywords of two characters or more in order of appearance, lower case, without stopwords. Null gives none."""
    drop = F.array(*[F.lit(w) for w in STOPWORDS if w not in TECH_TERMS])
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({KEYWORD})"), 1)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~F.array_contains(drop, t)))


def word_count(text: Column) -> Column:
    """Pieces between white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\S+)"), 1))


def occurrences(text: Column, token: Column) -> Column:
    """Non-overlapping occurrences of a token."""
    return (F.length(text) - F.length(F.replace(text, token))) / F.length(token)


def bm25_lite(tokens: list[str], text: Column, section: Column, avg_words: Column, n_words: Column | None = None) -> Column:
    """Saturated term frequency of each token in text and section path, summed; no inverse document frequency.

    k1 1.2, b 0.75, and 0.30 more for each occurrence in the section path. Tokens are
    plain strings, so the sum is one flat expression. ``n_words`` saves counting
    the text's words again where they are a column already.
    """
    body, path = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(section, F.lit("")))
    norm = 0.25 + 0.75 * (F.greatest(F.lit(1.0), (word_count(body) if n_words is None else n_words).cast("double")) / F.greatest(F.lit(1.0), avg_words))
    score = F.lit(0.0)
    for t in tokens:
        in_path = occurrences(path, F.lit(t))
        tf = occurrences(body, F.lit(t)) + in_path
        score = score + F.when(tf > 0, tf * 2.2 / (tf + 1.2 * norm) + 0.30 * in_path).otherwise(0.0)
    return score


def contains_any(tokens: list[str], text: Column) -> Column:
    """Whether any token occurs in the text, as a piece of any word; whatever the case."""
    low, hit = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for t in tokens:
        hit = hit | F.contains(low, F.lit(t))
    return hit


def title_matches(tokens: list[str], title: Column) -> Column:
    """Whether a whole keyword of the title is among the tokens."""
    if not tokens:
        return F.lit(False)
    return F.arrays_overlap(keywords(title), F.array(*[F.lit(t) for t in tokens]))


def is_boilerplate(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(BOILERPLATE)), F.lit(False))


def token_count(text: Column) -> Column:
    """Tokens by a plain rule: runs of word characters, and single signs. A tokenizer hook may replace it."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\w+|[^\w\s])"), 1))


def paragraphs(text: Column) -> Column:
    """Stripped, non-empty parts between blank lines."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\n\s*\n+"), strip)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    """Parts between a sentence end and white space before a capital, bracket or quote."""
    parts = F.transform(F.split(strip(F.coalesce(text, F.lit(""))), r"""(?<=[.!?])\s+(?=[A-Z(\["'“])"""), strip)
    return F.filter(parts, lambda p: p != "")


def fenced_paragraphs(text: Column) -> Column:
    """Paragraphs, but blank lines inside ``` fences don't split, and a closing fence ends its paragraph."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    start = F.struct(F.lit(False).alias("fence"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def flush(s: Column, extra: Column | None = None) -> Column:
        now = s["now"] if extra is None else F.concat(s["now"], extra, F.lit("\n"))
        done = strip(now)
        return F.when(done != "", F.concat(s["out"], F.array(done))).otherwise(s["out"])

    def step(s: Column, line: Column) -> Column:
        mark, blank = strip(line).startswith("```"), strip(line) == ""
        add = F.concat(s["now"], line, F.lit("\n"))
        return (
            F.when(mark & s["fence"], F.struct(F.lit(False).alias("fence"), F.lit("").alias("now"), flush(s, line).alias("out")))
            .when(mark, F.struct(F.lit(True).alias("fence"), add.alias("now"), s["out"].alias("out")))
            .when(blank & ~s["fence"], F.struct(F.lit(False).alias("fence"), F.lit("").alias("now"), flush(s).alias("out")))
            .otherwise(F.struct(s["fence"].alias("fence"), add.alias("now"), s["out"].alias("out")))
        )

    return F.aggregate(lines, start, step, lambda s: flush(s))


def join_split_decimals(text: Column) -> Column:
    """``3 . 14`` becomes ``3.14``."""
    return F.regexp_replace(text, r"(?<=\d)\s+\.\s*(?=\d)", ".")


def strip_html(html: Column) -> Column:
    """Without tags; then the four named entities, &amp; last."""
    out = F.regexp_replace(html, r"<[^>]+>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def preview(text: Column, size: int = 120) -> Column:
    """White space collapsed, cut to ``size`` characters."""
    return F.substring(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "), 1, size)


def normal_email(address: Column) -> Column:
    return F.lower(strip(address))


def clock(seconds: Column) -> Column:
    """Seconds as m:ss."""
    whole = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", (whole / 60).cast("int"), whole % 60)


def readable_bytes(content: Column) -> Column:
    """Bytes as UTF-8, with replacement characters for what isn't."""
    return F.make_valid_utf8(content.cast("string"))


def markdown_table_size(markdown: Column) -> Column:
    """struct(rows, cols) of a pipe table: lines that start with a pipe, without the rule line; pipes of the first less one."""
    lines = F.filter(F.split(F.coalesce(markdown, F.lit("")), "\n"), lambda x: F.startswith(F.ltrim(x), F.lit("|")) & ~F.contains(x, F.lit("---")))
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    pipes = F.length(first) - F.length(F.replace(first, F.lit("|")))
    return F.struct(F.size(lines).alias("rows"), F.greatest(pipes - 1, F.lit(0)).alias("cols"))
