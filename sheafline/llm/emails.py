"""The text that an email's own sender wrote, by semi-Markov decoding of its spans.

A mail is a sequence of spans: authored, quoted (with its introduction), forwarded
(a header block and all below it), signature, disclaimer. The decoder picks the
spans of highest total score: scores of the lines within, boundary cues where a
span starts, whole-span features such as its length, and transitions. Lines of
one plain kind in a row are one unit, so long mails cost little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

A, Q, F_, S, D = range(5)
LABELS = ("authored", "quoted", "forwarded", "signature", "disclaimer")
_NO = -1e9
#: Lines of a signature beyond which each costs, and the cost of a signature or disclaimer that holds none of its cues.
LONGEST_SIGNATURE = 8
WITHOUT_CUE = 3.0
#: Longest span in units; longer ones go on as another span of the same label at no cost.
MAX_UNITS = 24

# Cues in the languages of the mails, matched without case.
_PREFIX = re.compile(r"^\s*(?:>|&gt;|\|)")
_INTRO = re.compile(
    r"^\s*(?:on\b.{4,90}\bwrote\s*:|.{0,80}[<(]?\S+@\S+[>)]?\s+wrote(?:\s+on\s.{4,30})?\s*:|am\b.{4,90}\bschrieb\b.{0,60}:|le\b.{4,90}a\s+écrit\s*:|el\b.{4,90}escribió\s*:|quoting\s.{2,90}:|in\s+(?:a\s+)?message\s.{2,90}wrote\s*:)\s*$",
    re.I,
)
_INTRO_TAIL = re.compile(r"^\s*[<(]?\S+@\S+[>)]?\s*(?:wrote|schrieb|escribió|a écrit)?\s*(?:on\s.{4,30})?:\s*$", re.I)
_FORWARD = re.compile(r"^\s*(?:-{2,}\s*(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message transféré|mensaje original|mensaje reenviado)\s*-*|begin forwarded message\s*:|anfang der weitergeleiteten (?:nachricht|e-mail)\s*:|début du message (?:réexpédié|transféré)\s*:)\s*$", re.I)
_RULE = re.compile(r"^\s*_{8,}\s*$")
_HEADER = re.compile(r"^\s*\**(from|sent|date|to|cc|subject|von|gesendet|datum|an|betreff|de|envoyé|à|objet|enviado|fecha|para|asunto)\s*:\**(?:\s|$)", re.I)
_HEADER_TOP = re.compile(r"^\s*\**(from|von|de)\s*:\**\s*\S", re.I)
_CLOSING = re.compile(
    r"^\s*(?:(?:with\s+)?(?:best|kind|warm|kindest|warmest)?\s*regards|best(?:\s+wishes)?|many thanks|thanks(?: again)?|thank you|cheers|(?:yours\s+)?(?:sincerely|faithfully|truly)|mit freundlichen grüßen|mit freundlichem gruß|freundliche grüße|viele grüße|beste grüße|liebe grüße|cordialement|bien cordialement|bien à vous|salutations|saludos(?: cordiales)?|un saludo|atentamente|mfg|br|kr)\s*[,.!]?\s*$",
    re.I,
)
_SIG_DASH = re.compile(r"^--\s*$")
_DEVICE = re.compile(r"^\s*(?:sent|gesendet|von|envoyé|enviado|get|diese nachricht wurde)\b.{0,20}\b(?:from|von|meinem|mobilgerät|depuis|desde|mon|mi)\b.{0,40}$", re.I)
_CONTACT = re.compile(r"^\s*(?:(?:tel|phone|mobile?|fax|tél|fon|telefon|office)\b[.:\s]*[+(\d].*|[\w.+-]+@[\w.-]+\.\w+|(?:https?://|www\.)\S+|[^|.!?]{2,40}\|[^|.!?]{2,40})\s*$", re.I)
_STARS = re.compile(r"^\s*(?:\*{6,}|={6,}|~{6,}|#{6,})\s*$")
_GREETING = re.compile(r"^\s*(?:hi|hello|dear|good (?:morning|afternoon|evening)|hey|hallo|liebe[rs]?|guten (?:morgen|tag|abend)|sehr geehrte[rs]?|bonjour|cher|chère|hola|estimad[oa]|buenos días)\b.{0,40}$", re.I)
_NAME = re.compile(r"^\s*(?:[A-ZÀ-Þ][\w'’-]+)(?:\s+[A-ZÀ-Þ][\w'’.-]*){0,3}\s*$")
_STRONG = re.compile(
    r"confidentiality notice|legally protected|disclosure|named recipient|intended solely|addressee|privileged|in error|ist vertraulich|genannten empfänger|unbefugte|nicht gestattet|est confidentiel|diffusion non autorisée|par erreur|le détruire|views in this mail|do not bind|liability|caused by viruses|environment before printing|unauthori[sz]ed|este mensaje es confidencial|destinatario",
    re.I,
)
_WEAK = re.compile(r"\bconfidential\b|\bprohibited\b|\btell the sender\b|\bdelete it\b|\bbestimmt\b|\bvertraulich\b|\bdétruire\b|\brecipient\b", re.I)

#: Scores of a line of each kind within a span of each label (authored, quoted, signature, disclaimer).
KINDS = {
    "blank": (0.0, 0.0, -0.1, -0.1),
    "prefix": (-12.0, 4.0, -12.0, -12.0),
    "intro": (-6.0, 6.0, -8.0, -8.0),
    "forward": (-8.0, -4.0, -8.0, -8.0),
    "header": (-3.0, -6.0, -5.0, -6.0),
    "closing": (-4.0, -8.0, 4.0, -4.0),
    "dash": (-6.0, -8.0, 5.0, -2.0),
    "device": (-8.0, -8.0, 6.0, 0.0),
    "contact": (-5.0, -8.0, 4.0, -2.0),
    "stars": (-5.0, -8.0, -2.0, 4.0),
    "greeting": (3.0, -8.0, -5.0, -5.0),
    "name": (-0.2, -8.0, 2.0, -1.5),
    "strong": (-4.0, -8.0, -4.0, 4.0),
    "weak": (0.6, -8.0, -4.0, 1.5),
    "tail": (0.6, -8.0, -4.0, 0.7),
    "body": (1.0, -8.0, -4.0, -2.0),
}
#: A forwarded message may hold whatever a mail does, and its own header besides.
KINDS = {k: (a, q, max(a, q, s, d, 2.0 if k in ("forward", "header") else 0.0), s, d) for k, (a, q, s, d) in KINDS.items()}
#: Boundary cues: score of a span of each label that starts with a unit of the kind.
STARTS = {
    "authored": {},
    "quoted": {"prefix": 0.0, "intro": 2.0},
    "forwarded": {"forward": 3.0},
    "signature": {"closing": 2.0, "dash": 3.0, "device": 1.0, "contact": -1.0, "name": -1.0},
    "disclaimer": {"strong": 1.0, "stars": 2.0},
}
#: Units that a span of a label should hold one of.
CUES = {S: ("closing", "dash", "device", "contact", "name"), D: ("strong", "stars", "weak")}
_OTHER = {"authored": 0.0, "quoted": _NO, "forwarded": _NO, "signature": -6.0, "disclaimer": -6.0}
#: Transitions, from row to column.
MOVES = (
    (0.0, 0.0, 0.0, 0.0, 0.0),
    (0.0, 0.0, 0.0, 0.0, 0.0),
    (_NO, _NO, 0.0, _NO, _NO),
    (-3.0, 0.0, 0.0, -1.0, 0.0),
    (-3.0, 0.0, 0.0, -0.5, 0.0),
)


def kinds_of(lines: list[str]) -> list[str]:
    """The kind of each line by its cues."""
    out: list[str] = []
    for i, line in enumerate(lines):
        nxt = lines[i + 1] if i + 1 < len(lines) else ""
        if not line.strip():
            kind = "blank"
        elif _PREFIX.match(line):
            kind = "prefix"
        elif _FORWARD.match(line):
            kind = "forward"
        elif _RULE.match(line):
            kind = "forward" if _HEADER_TOP.match(nxt) else "stars"
        elif _INTRO.match(line) or (_INTRO_TAIL.match(line) and out and out[-1] == "intro"):
            kind = "intro"
        elif len(line) < 100 and _INTRO_TAIL.match(nxt) and not _PREFIX.match(nxt) and i + 2 < len(lines) and any(_PREFIX.match(x) for x in lines[i + 2 : i + 4]) and not _CONTACT.match(line):
            kind = "intro"
        elif _HEADER_TOP.match(line) and sum(bool(_HEADER.match(x)) for x in lines[i : i + 6]) >= 3:
            kind = "forward"
        elif _HEADER.match(line) and out and out[-1] in ("forward", "header"):
            kind = "header"
        elif _CLOSING.match(line):
            kind = "closing"
        elif _SIG_DASH.match(line):
            kind = "dash"
        elif _DEVICE.match(line) and len(line) < 60 and not line.rstrip().endswith("."):
            kind = "device"
        elif _STRONG.search(line):
            kind = "strong"
        elif _STARS.match(line):
            kind = "stars"
        elif _CONTACT.match(line):
            kind = "contact"
        elif _GREETING.match(line):
            kind = "greeting"
        elif _NAME.match(line) and len(line) < 40:
            kind = "name"
        elif _WEAK.search(line):
            kind = "weak"
        elif len(line) < 30 and out and out[-1] in ("strong", "weak"):
            kind = "tail"
        else:
            kind = "body"
        out.append(kind)
    return out


def entered(i: int, before: list[float], start: list[float], kind: str) -> list[tuple[int, float, int | None]]:
    """(label, score, label before) of the best way to begin a span at unit i, for each label that can.

    Quoted and forwarded spans begin with their cues, or go on after one of their own.
    """
    out: list[tuple[int, float, int | None]] = []
    for lab in range(5):
        own = start[lab]
        if i and before[lab] > _NO and (lab == F_ or lab == Q and kind in ("prefix", "intro", "blank")):
            own = max(own, 0.0)
        if own <= _NO:
            continue
        if i == 0:
            out.append((lab, own, None))
        else:
            alone = lab in (F_, Q) and start[lab] <= _NO
            score, prev = max((before[p] + MOVES[p][lab], -p) for p in range(5) if not alone or p == lab)
            if score > _NO:
                out.append((lab, score + own, -prev))
    return out


def decode(text: str) -> list[tuple[int, int, int]]:
    """Spans (label, first line, end line) of a text, lines split at line feeds and counted from 0."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    kinds = kinds_of(lines)
    units: list[list] = []  # kind, first line, end line
    for i, kind in enumerate(kinds):
        if units and units[-1][0] == kind and kind in ("body", "prefix", "blank", "strong", "header"):
            units[-1][2] = i + 1
        else:
            units.append([kind, i, i + 1])
    n = len(units)
    sums = [[0.0] * (n + 1) for _ in LABELS]
    filled = [0] * (n + 1)
    for u, (kind, a, b) in enumerate(units):
        size = b - a
        filled[u + 1] = filled[u] + (0 if kind == "blank" else size)
        for lab in range(5):
            sums[lab][u + 1] = sums[lab][u] + KINDS[kind][lab] * size
    starts = [[STARTS[name].get(units[u][0], _OTHER[name]) for name in LABELS] for u in range(n)]
    cues = [[0] * (n + 1) for _ in LABELS]  # units that speak for a signature or a disclaimer
    for u, (kind, _, _) in enumerate(units):
        for lab in (S, D):
            cues[lab][u + 1] = cues[lab][u] + (kind in CUES[lab])
    best = [[_NO * 2] * 5 for _ in range(n + 1)]
    back: list[list] = [[None] * 5 for _ in range(n + 1)]
    enter: list[list[tuple[int, float, int | None]]] = []  # the best way to a span of each label that starts with unit i
    best[0] = [0.0] * 5
    for j in range(1, n + 1):
        enter.append(entered(j - 1, best[j - 1], starts[j - 1], units[j - 1][0]))
        here, from_ = best[j], back[j]
        for i in range(max(0, j - MAX_UNITS), j):
            for lab, way, prev in enter[i]:
                total = way + sums[lab][j] - sums[lab][i]
                if lab == S:
                    total -= 2.0 * max(0, filled[j] - filled[i] - LONGEST_SIGNATURE)
                if lab in CUES and cues[lab][j] == cues[lab][i] and prev != lab:
                    total -= WITHOUT_CUE
                if total > here[lab]:
                    here[lab], from_[lab] = total, (i, prev)
    spans = []
    j, lab = n, max(range(5), key=lambda x: best[n][x])
    while j > 0:
        i, prev = back[j][lab]
        spans.append((lab, units[i][1], units[j - 1][2]))
        j, lab = i, prev
    return spans[::-1]


def line_labels(mails: DataFrame) -> DataFrame:
    """mail_id, line_no (from 1), label, line of every line that isn't blank.

    A mail delivered again gives equal rows, which count once. Null texts give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for mail, text in zip(pdf["mail_id"], pdf["text"]):
                if text is None or not text.strip():
                    continue
                lines = text.split("\n")
                for lab, a, b in decode(text):
                    rows.extend((mail, k + 1, LABELS[lab], lines[k].rstrip("\r")) for k in range(a, b) if lines[k].strip())
            yield pd.DataFrame(rows, columns=["mail_id", "line_no", "label", "line"])

    return mails.select("mail_id", "text").mapInPandas(run, "mail_id long, line_no long, label string, line string").distinct()


def found(mails: DataFrame) -> DataFrame:
    """p6_found: every line with newly written text."""
    return line_labels(mails).where("label = 'authored'").select("mail_id", "line_no").distinct()
