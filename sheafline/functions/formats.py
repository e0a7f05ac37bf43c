"""Formats, routes and mime types of files, by magic bytes and extension."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each route, and mime types that are pinned by format.
EXTENSIONS = {
    "PDF": ("pdf",),
    "SKIP": ("doc", "ppt", "xls"),
    "PPTX_NATIVE": ("pptx",),
    "DOCLING": ("docx", "xlsx", "epub", "html", "htm", "tex"),
    "IMAGE": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp", "avif", "heic", "heif"),
    "AUDIO": ("mp3", "wav", "m4a", "flac", "ogg", "aac", "wma"),
    "VIDEO": ("mp4", "avi", "mov", "webm", "mkv", "flv", "wmv", "m4v"),
    "TEXT": (
        "txt", "md", "markdown", "csv", "tsv", "rtf", "ipynb", "py", "pyi", "pyx", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go", "rs", "java", "kt", "kts", "scala", "c", "h", "cpp", "cc", "cxx", "hpp", "hh",
        "rb", "php", "swift", "m", "mm", "sh", "bash", "zsh", "fish", "yaml", "yml", "toml", "ini", "conf", "json", "jsonl", "ndjson", "xml", "svg", "rst", "eml", "msg",
    ),
}
#: Formats that go by their kind, whatever the extension.
KINDS = ("IMAGE", "AUDIO", "VIDEO")
MIME = {
    "PDF": "application/pdf",
    "DOCX": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "PPTX": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "XLSX": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "EPUB": "application/epub+zip",
    "HTML": "text/html",
    "TEX": "application/x-tex",
    "IPYNB": "application/x-ipynb+json",
    "TXT": "text/plain",
    "MD": "text/markdown",
    "MARKDOWN": "text/markdown",
    "CSV": "text/csv",
    "TSV": "text/tab-separated-values",
    "RTF": "application/rtf",
}
ROUTE_OF = {ext.upper(): route for route, exts in EXTENSIONS.items() for ext in exts} | {k: k for k in KINDS}


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def format_of_name(path: Column) -> Column:
    """The extension in capitals if a route knows it, its kind for images, audio and video, else empty."""
    fmt = F.upper(extension(path))
    out = F.when(fmt.isin(sorted(ROUTE_OF)), fmt).otherwise("")
    for kind in KINDS:
        out = F.when(fmt.isin([e.upper() for e in EXTENSIONS[kind]]), kind).otherwise(out)
    return out


def zip_kind(content: Column) -> Column:
    """DOCX, PPTX, XLSX or EPUB by the names in a container's directory; null if it has none of them or can't be read."""

    def of(data: bytes | None) -> str | None:
        import io
        import zipfile

        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist() if data is not None else []
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
            return None
        for part, kind in (("word/", "DOCX"), ("ppt/", "PPTX"), ("xl/", "XLSX")):
            if any(n.startswith(part) for n in names):
                return kind
        return "EPUB" if "META-INF/container.xml" in names else None

    def kinds(column: pd.Series) -> pd.Series:
        return column.map(of)

    return F.pandas_udf(kinds, "string")(content)


def format_of_file(path: Column, content: Column) -> Column:
    """The format by the first bytes, else by extension. ZIP containers go by the names in their directory, in a fixed order."""
    head = F.hex(F.substring(content, 1, 8))

    def starts(magic: str) -> Column:
        return F.startswith(head, F.hex(F.lit(magic)))

    zipped = F.startswith(head, F.lit("504B0304"))
    by_name = format_of_name(path)
    return F.when(starts("%PDF-"), "PDF").when(starts("{\\rtf"), "RTF").otherwise(F.coalesce(zip_kind(F.when(zipped, content)), by_name))


def is_pdf(content: Column) -> Column:
    """Whether the first bytes are a PDF head with a version."""
    return F.coalesce(F.decode(F.substring(content, 1, 11), "ISO-8859-1").rlike(r"^%PDF-\d\.\d"), F.lit(False))


def route_of(fmt: Column) -> Column:
    return _lookup(ROUTE_OF, F.upper(F.coalesce(fmt, F.lit(""))), "SKIP")


def mime_of(fmt: Column) -> Column:
    return _lookup(MIME, F.upper(F.coalesce(fmt, F.lit(""))), "application/octet-stream")


def convertible() -> list[str]:
    """Extensions that some route takes."""
    return sorted(e.lower() for e, r in ROUTE_OF.items() if r != "SKIP" and e not in KINDS)
