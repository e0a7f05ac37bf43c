"""The document schema as Spark types; nested documents exist at the sinks only."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = "1.0"
#: The kinds of nodes and documents.
NODE_TYPES = ("document", "section", "table", "figure", "list", "chunk")
MODAL_TYPES = ("document", "image", "audio", "video")

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()
_BOX = T.ArrayType(_I)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name.rstrip("_"), kind) for name, kind in fields.items()])


SOURCE = _struct(uri=_S, format=_S, route=_S, mime_type=_S, size_bytes=_L, checksum=_S, timestamp=_TS)
METADATA = _struct(title=_S, author=_S, created=_TS, modified=_TS, page_count=_I, language=_S, domain=_S, format=_S)
ENTITY = _struct(text=_S, type=_S, confidence=_D)
RELATIONSHIP = _struct(from_=_S, to=_S, type=_S, confidence=_D)
CHUNK = _struct(id=_S, type=_S, text=_S, token_count=_I, page=_I, bounding_box=_BOX, confidence=_D, region_kind=_S, section_path=_S)
SECTION = _struct(id=_S, type=_S, title=_S, page=_I, bounding_box=_BOX, children=T.ArrayType(CHUNK))
SEMANTICS = _struct(entities=T.ArrayType(ENTITY), relationships=T.ArrayType(RELATIONSHIP), topics=T.ArrayType(_S))
PROVENANCE = _struct(extraction=_struct(model=_S, version=_S, timestamp=_TS), normalization=_struct(version=_S, timestamp=_TS))
#: A node as a flat row; the tree is these rows.
NODE = _struct(doc_id=_S, node_id=_S, parent_id=_S, depth=_I, child_no=_L, node_type=_S, title=_S, page=_I, box=_S)
DOCUMENT = _struct(schema_version=_S, id=_S, modal_type=_S, source=SOURCE, metadata=METADATA, sections=T.ArrayType(SECTION), semantics=SEMANTICS, provenance=PROVENANCE)


def exported() -> str:
    """The document schema as JSON, for other readers."""
    return DOCUMENT.json()
