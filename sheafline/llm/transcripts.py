"""Speech transcripts into clean, ordered speaker turns.

Lines are cut from the drafts, their labels, marks, notes and fillers told apart
on the JVM side, speakers normalised and carried forward. Where adjacent lines name
their speakers, the names tell whether a new turn begins; where they don't, a
gradient-boosted classifier, fitted on pairs that do, decides it from gaps and context.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm.conversations import one_each
from sheafline.operators.ordered import HOT_ROWS, ordered_scan
from sheafline.session import materialize

#: Bound of the labelled pairs that the boundary classifier is fitted on.
SAMPLE_PAIRS = 4000

_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
#: A speaker label at the start of a line: an optional mark, a speaker word, a number, an optional mark, an end sign.
LABEL = (
    r"(?i)^\s*(?:[\[(]?" + _CLOCK + r"[\])]?\s*[-:]?\s*)?(?:<v[.\w]*\s+)?[\[(]?(?:speaker|spkr|spk|s)[\s_.\-#]*0*(\d{1,3})[\])]?"
    r"(?:\s*[\[(]" + _CLOCK + r"[\])]\s*(?::|>>?|-(?=\s)|(?=\s|$))|\s*:|\s*>>?|\s+-(?=\s|$)|\s*[\])]:?)"
)
_TIMING = r"^\s*" + _CLOCK + r"\s*-->\s*" + _CLOCK + r".*$"
_CUE = r"^\s*\d+\s*$"
_MARK = r"[\[(<{]\s*" + _CLOCK + r"(?:\s*-+>?\s*" + _CLOCK + r")?\s*[\])>}]"
_NOTE = r"\[[^\[\]]*\]|\([^()]*\)|<[^<>]*>|\{[^{}]*\}|\*[^*\s][^*]*\*|[♪♫][^♪♫]*[♪♫]?"
#: Filler phrases set off from the sentence.
_PHRASE = r"(?i)(?<![\p{L}\p{N}])(?:you know|i mean)(?![\p{L}\p{N}'’-])[,.…]*"
#: A token that is a hesitation: letters of the uh, um, er, ah, hm families, stretched or doubled by a hyphen.
HESITATION = r"(?i)^[^\p{L}\p{N}]*(?:u+h+|u+h*m+|e+r+m*|e+h+m*|a+h+|h+m+|m+h*m*|u+h+-h?u+h+|m+-h?m+|h+u+h+)[^\p{L}\p{N}]*$"


def speaker_name(number: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("SPEAKER_%02d", number))


def spoken_words(line: Column) -> Column:
    """The tokens of a line that are words: without label, marks, notes and fillers."""
    body = F.regexp_replace(line, _TIMING, " ")
    body = F.regexp_replace(body, LABEL, " ")
    body = F.regexp_replace(body, _MARK, " ")
    body = F.regexp_replace(body, _NOTE, " ")
    body = F.regexp_replace(body, _PHRASE, " ")
    tokens = F.split(body, r"(?U)\s+")
    return F.when(line.rlike(_CUE), F.array().cast("array<string>")).otherwise(F.filter(tokens, lambda t: t.rlike(r"[\p{L}\p{N}]") & ~t.rlike(HESITATION)))


def lines_of(drafts: DataFrame) -> DataFrame:
    """One row per line of each draft, with its own label, the label carried to it, and its words.

    A draft's lines stay in one row's array until they are exploded, so carrying
    labels within a draft needs no shuffle. Null texts have no lines.
    """
    seg = F.col("modal_features.audio_segment")
    one = one_each(drafts.select("draft_id", "doc_id", "text", seg["start_s"].alias("start_s"), seg["end_s"].alias("end_s"), seg["speaker"].alias("given")).where("draft_id is not null"), "draft_id")
    lines = F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")
    own = F.regexp_extract("line", LABEL, 1)
    given = F.regexp_extract("given", r"(?i)^\s*(?:speaker|spkr|spk|s)?[\s_.\-#]*0*(\d{1,3})\s*$", 1)
    rows = one.select("draft_id", "doc_id", "start_s", "end_s", F.when(given != "", given.cast("int")).alias("given_no"), F.posexplode(lines).alias("line_no", "line"))
    rows = rows.withColumn("own_no", F.when(own != "", own.cast("int"))).withColumn("words", spoken_words(F.col("line")))
    # carried within the draft: a draft is one row's text, so this window is small
    w = Window.partitionBy("draft_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("carried", F.last("own_no", ignorenulls=True).over(w))
    return rows.withColumn("speaker", F.coalesce(speaker_name(F.coalesce("carried", "given_no")), F.lit("UNKNOWN")))


def pairs_of(lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Lines with words, each with the line before it in its recording as features of the pair."""
    spoken = lines.where(F.size("words") > 0).select(
        "doc_id",
        "draft_id",
        "line_no",
        F.coalesce("start_s", F.lit(float("inf"))).alias("at"),
        "start_s",
        "end_s",
        "own_no",
        "speaker",
        F.size("words").cast("long").alias("n_words"),
        F.array_join("words", " ").alias("said"),
    )
    ended, asked = F.col("said").rlike(r"[.!?…]\W*$"), F.col("said").rlike(r"[?]\W*$")
    before = F.struct("draft_id", "end_s", "own_no", "speaker", "n_words", ended.alias("ended"), asked.alias("asked"))
    p = ordered_scan(spoken, ["doc_id"], ["at", "draft_id", "line_no"], prevs={"before": before}, hot_rows=hot_rows, counted=lines.select("doc_id"))
    same_draft = F.coalesce(F.col("before.draft_id") == F.col("draft_id"), F.lit(False))
    gap = F.when(same_draft, 0.0).otherwise(F.coalesce(F.least(F.greatest(F.col("start_s") - F.col("before.end_s"), F.lit(-5.0)), F.lit(60.0)), F.lit(0.0)))
    return p.select(
        *spoken.columns,
        F.col("before").isNull().alias("first"),
        F.coalesce(F.col("before.speaker") != F.col("speaker"), F.lit(True)).alias("differs"),
        ((F.col("speaker") == "UNKNOWN") & F.coalesce(F.col("before.speaker") == "UNKNOWN", F.lit(False))).alias("unnamed"),
        (F.col("own_no").isNotNull() & F.col("before.own_no").isNotNull()).alias("labelled"),
        F.coalesce((F.col("own_no") != F.col("before.own_no")).cast("double"), F.lit(0.0)).alias("label"),
        same_draft.cast("double").alias("f_same_draft"),
        gap.alias("f_gap"),
        F.coalesce(F.col("before.ended").cast("double"), F.lit(1.0)).alias("f_ended"),
        F.coalesce(F.col("before.asked").cast("double"), F.lit(0.0)).alias("f_asked"),
        F.col("said").rlike(r"^\W*\p{Lu}").cast("double").alias("f_capital"),
        F.least(F.col("n_words"), F.lit(200)).cast("double").alias("f_words"),
        F.least(F.coalesce(F.col("before.n_words"), F.lit(0)), F.lit(200)).cast("double").alias("f_words_before"),
    )


#: What is known of a pair of lines whether or not they carry labels.
FEATURES = ["f_same_draft", "f_gap", "f_ended", "f_asked", "f_capital", "f_words", "f_words_before"]


def boundaries(pairs: DataFrame, sample: int = SAMPLE_PAIRS) -> DataFrame:
    """Add ``boundary``: whether a new turn begins at this line.

    Fitted on at most ``sample`` adjacent pairs that both carry a label of their
    own (target: the labels differ), taken in order of a hash of their key; then
    used for all pairs. With fewer than 20 such pairs or one class only, a pair
    within one draft is one turn and others aren't. The first line of a recording begins a turn.
    """
    train = pairs.where("labelled and not first").orderBy(F.xxhash64("draft_id", "line_no")).limit(sample).select("label", *FEATURES)
    rows = train.collect()
    if len(rows) < 20 or len({r["label"] for r in rows}) < 2:
        return pairs.withColumn("boundary", (F.col("f_same_draft") == 0) | F.col("first"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    data = pairs.sparkSession.createDataFrame(rows).coalesce(1)
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=5, maxDepth=3, seed=7).fit(assembler.transform(data))
    scored = model.transform(assembler.transform(pairs))
    return scored.withColumn("boundary", (F.col("prediction") > 0.5) | F.col("first")).drop("features", "rawPrediction", "probability", "prediction")


def turns(drafts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every spoken line in its turn: doc_id, turn (from 1), speaker, draft_id, line_no, at, n_words, said, boundary.

    A turn begins where the named speaker changes and, between lines that name none,
    where the classifier says so. Recordings without words give no rows.
    """
    pairs = materialize(pairs_of(lines_of(drafts), hot_rows))
    cut = F.col("first") | F.col("differs") | (F.col("unnamed") & F.col("boundary"))
    placed = ordered_scan(boundaries(pairs).withColumn("new", cut.cast("long")), ["doc_id"], ["at", "draft_id", "line_no"], sums={"turn": F.col("new")}, hot_rows=hot_rows, counted=pairs)
    return placed.select("doc_id", "turn", "speaker", "draft_id", "line_no", "start_s", "end_s", "n_words", "said", "boundary")


def stated(turn: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, turn, speaker, n_words: neighbouring turns of one speaker joined, those of unnamed ones too."""
    each = turn.groupBy("doc_id", "turn").agg(F.first("speaker").alias("speaker"), F.sum("n_words").alias("n_words"))
    each = ordered_scan(each, ["doc_id"], ["turn"], prevs={"before": F.struct("speaker")}, hot_rows=hot_rows)
    new = F.coalesce((F.col("before.speaker") != F.col("speaker")).cast("long"), F.lit(1))
    joined = ordered_scan(each.withColumn("new", new), ["doc_id"], ["turn"], sums={"no": F.col("new")}, hot_rows=hot_rows)
    return joined.groupBy("doc_id", F.col("no").alias("turn")).agg(F.first("speaker").alias("speaker"), F.sum("n_words").alias("n_words"))


def found(drafts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """p4_found: every turn with its speaker and number of words, as the stated rule joins them."""
    return stated(materialize(turns(drafts, hot_rows).select("doc_id", "turn", "speaker", "n_words")), hot_rows)
