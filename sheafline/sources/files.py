"""Files as DataFrames: scan, routing, and the lanes that need no model."""

from __future__ import annotations

import email
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from email import policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions import formats, ids
from sheafline.functions import text as T

#: Largest file that a lane reads; a larger one is reported, not cut.
MAX_BYTES = 256 << 20
_EMU_CANVAS = 1000
_CODEPAGES = ("utf-8", "cp1252", "latin-1")


def scan(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """Files below a folder whose extension some route takes: path, format, route, mime_type, size_bytes, checksum, title, modified, doc_node, content.

    A path comes once. The extension filter and column pruning reach the scan, so
    content is read only where a later step uses it.
    """
    exts = only or formats.convertible()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.where(formats.extension(F.col("path")).isin(exts))
    fmt = formats.format_of_file(F.col("path"), F.col("content"))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("format", fmt).select(
        "path",
        "format",
        formats.route_of(F.col("format")).alias("route"),
        formats.mime_of(F.col("format")).alias("mime_type"),
        F.col("length").alias("size_bytes"),
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"),
        F.coalesce(T.none_if_blank(F.regexp_replace(name, r"\.[^.]*$", "")), F.lit("(untitled)")).alias("title"),
        F.col("modificationTime").alias("modified"),
        ids.node_id("doc", F.col("path")).alias("doc_node"),
        "content",
    )


def rtf_text(data: bytes) -> str:
    """The text of an RTF file: control words and groups of definitions dropped, paragraphs as blank lines."""
    raw = next((data.decode(c) for c in _CODEPAGES if _decodes(data, c)), "")
    out, skip, depth, i = [], [], 0, 0
    while i < len(raw):
        c = raw[i]
        if c == "{":
            depth += 1
            i += 1
        elif c == "}":
            skip = [d for d in skip if d < depth]
            depth -= 1
            i += 1
        elif c == "\\":
            m = re.compile(r"\\(?:'([0-9a-fA-F]{2})|u(-?\d+)\s?\??|([a-z]+)(-?\d+)? ?|(\W))").match(raw, i)
            if not m:
                i += 1
                continue
            code, uni, word, _, sign = m.groups()
            i = m.end()
            if sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
                skip.append(depth)
            elif not skip:
                if code:
                    out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
                elif uni:
                    out.append(chr(int(uni) % 65536))
                elif word in ("par", "page", "sect"):
                    out.append("\n\n")
                elif word == "line":
                    out.append("\n")
                elif word == "tab":
                    out.append("\t")
                elif sign in ("{", "}", "\\"):
                    out.append(sign)
        else:
            if not skip and c not in "\r\n":
                out.append(c)
            i += 1
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def _decodes(data: bytes, codepage: str) -> bool:
    try:
        data.decode(codepage)
    except UnicodeDecodeError:
        return False
    return True


def notebook_text(data: bytes) -> str:
    """A notebook's cells: text as it is, code fenced with the kernel's language, outputs dropped."""
    book = json.loads(data.decode("utf-8", "replace"))
    language = ((book.get("metadata") or {}).get("kernelspec") or {}).get("language") or "python"
    parts = []
    for cell in book.get("cells") or []:
        source = cell.get("source") or ""
        body = ("".join(source) if isinstance(source, list) else str(source)).strip()
        if body:
            parts.append(f"```{language}\n{body}\n```" if cell.get("cell_type") == "code" else body)
    return "\n\n".join(parts)


def mail_parts(data: bytes) -> dict[str, str]:
    """subject, from, to, date and text of a message: the first plain part, else the first HTML part without tags."""
    m = email.message_from_bytes(data, policy=policy.default)
    plain = html = None
    for part in m.walk():
        kind = part.get_content_type()
        if kind == "text/plain" and plain is None:
            plain = part.get_content()
            break
        if kind == "text/html" and html is None:
            html = part.get_content()
    if plain is None and html is not None:
        plain = re.sub(r"<[^>]+>", "", html)
        for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            plain = plain.replace(name, sign)
    return {k: str(m.get(k) or "") for k in ("subject", "from", "to", "date")} | {"text": (plain or "").strip()}


def slide_regions(data: bytes) -> list[tuple[int, int, str, str, list[int]]]:
    """(slide, order, label, text, box) of a presentation's shapes; boxes on the canvas, title shapes as headings."""
    ns = {"a": "http://schemas.openxmlformats.org/drawingml/2006/main", "p": "http://schemas.openxmlformats.org/presentationml/2006/main"}
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        size = ET.fromstring(z.read("ppt/presentation.xml")).find("p:sldSz", ns)
        width, height = (int(size.get(k)) for k in ("cx", "cy")) if size is not None else (9144000, 6858000)
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for number, name in enumerate(slides, 1):
            for order, shape in enumerate(ET.fromstring(z.read(name)).iter(f"{{{ns['p']}}}sp")):
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{{{ns['a']}}}t")) for p in shape.iter(f"{{{ns['a']}}}p")).strip()
                if not text:
                    continue
                kind = shape.find(".//p:nvPr/p:ph", ns)
                label = "heading" if kind is not None and kind.get("type") in ("title", "ctrTitle") else "paragraph"
                off, ext = shape.find(".//a:xfrm/a:off", ns), shape.find(".//a:xfrm/a:ext", ns)
                box = [0, 0, _EMU_CANVAS, _EMU_CANVAS]
                if off is not None and ext is not None:
                    x, y, w, h = int(off.get("x")), int(off.get("y")), int(ext.get("cx")), int(ext.get("cy"))
                    box = [max(0, min(_EMU_CANVAS, round(v * _EMU_CANVAS / s))) for v, s in ((x, width), (y, height), (x + w, width), (y + h, height))]
                    box = [min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])]
                out.append((number, order, label, text, box))
    return out


def texts(files: DataFrame) -> DataFrame:
    """path, format, text, error of the text route's files; a file that can't be read has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, fmt, data in zip(pdf["path"], pdf["format"], pdf["content"]):
                try:
                    if len(data) > MAX_BYTES:
                        raise ValueError(f"over {MAX_BYTES} bytes")
                    if fmt == "RTF":
                        text = rtf_text(bytes(data))
                    elif fmt == "IPYNB":
                        text = notebook_text(bytes(data))
                    elif fmt == "EML":
                        text = mail_parts(bytes(data))["text"]
                    else:
                        text = bytes(data).decode("utf-8", "replace")
                    rows.append((path, fmt, text, None))
                except Exception as e:  # noqa: BLE001 - a bad file must not end the job
                    rows.append((path, fmt, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "format", "text", "error"])

    return files.where("route = 'TEXT'").select("path", "format", "content").mapInPandas(run, "path string, format string, text string, error string")


def regions(text_rows: DataFrame) -> DataFrame:
    """Regions of texts: path, reading_order, label, text; fence-aware paragraphs, single ``#`` lines (not ``#!``) of Markdown as headings."""
    parts = text_rows.select("path", "format", F.posexplode(T.fenced_paragraphs(F.col("text"))).alias("reading_order", "text"))
    heading = F.col("format").isin("MD", "MARKDOWN", "IPYNB") & F.col("text").rlike(r"^#(?!!)") & ~F.contains("text", F.lit("\n"))
    return parts.select("path", "reading_order", F.when(heading, "heading").otherwise("paragraph").alias("label"), "text")


def mails(files: DataFrame) -> DataFrame:
    """path, subject, from, to, date, text, error of message files; one that can't be read has an error only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    m = mail_parts(bytes(data))
                except Exception as e:  # noqa: BLE001 - a bad file must not end the job
                    rows.append((path, *[None] * 5, f"{type(e).__name__}: {e}"[:500]))
                    continue
                rows.append((path, m["subject"], m["from"], m["to"], m["date"], m["text"], None))
            yield pd.DataFrame(rows, columns=["path", "subject", "from", "to", "date", "text", "error"])

    return files.where("format = 'EML'").select("path", "content").mapInPandas(run, "path string, subject string, `from` string, `to` string, date string, text string, error string")


def slides(files: DataFrame) -> DataFrame:
    """path, page, reading_order, label, text, box, error of presentations; one that can't be read is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows.extend([(path, *r, None) for r in slide_regions(bytes(data))])
                except Exception as e:  # noqa: BLE001 - a bad file must not end the job
                    rows.append((path, *[None] * 5, f"{type(e).__name__}: {e}"[:500]))
            out = pd.DataFrame(rows, columns=["path", "page", "reading_order", "label", "text", "box", "error"])
            yield out.astype({"page": "Int32", "reading_order": "Int32"})

    return files.where("format = 'PPTX'").select("path", "content").mapInPandas(run, "path string, page int, reading_order int, label string, text string, box array<int>, error string")


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Document files as path and payload, for ``operators.shred``; files that aren't valid UTF-8 keep replacement characters."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", T.readable_bytes(F.col("content")).alias("payload"))


def write_documents(docs: DataFrame, folder: str, text: str = "markdown", suffix: str = ".md") -> DataFrame:
    """One file per document (doc_id and a text column), written where the rows are; returns doc_id, path, n_bytes.

    ``folder`` must be shared by all executors. Files appear whole: they are written
    under another name and renamed, so a repeated task leaves the same files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["d"], pdf["t"]):
                name = re.sub(r"[^\w.-]", "_", str(d)) + suffix
                data = (t or "").encode()
                part = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, name))
                rows.append((str(d), os.path.join(folder, name), len(data)))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "n_bytes"])

    return docs.select(F.col("doc_id").cast("string").alias("d"), F.col(text).alias("t")).mapInPandas(run, "doc_id string, path string, n_bytes long")
