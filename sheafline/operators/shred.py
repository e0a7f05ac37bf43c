"""Nested records as columnar stripes with levels, and tables rebuilt from them.

The node tree of a payload repeats along one path, ``children``; below every node of
depth d hang the leaf paths id, type, title, page and ``bounding_box``, which repeats
once more. ``shred`` writes one entry per node of each depth, and one empty entry per
node of the depth above that has no children, with the levels of every leaf path:

* repetition level ``rep``: the depth at which this entry starts a new element, 0 for
  the first of a record. It holds for all leaf paths of the entry; of the numbers of a
  box the first has it and the others have d + 1, the level at which they repeat;
* definition level ``def``: how many repeated ancestors exist, so an entry of depth k
  holds a node exactly if it is k. Optional leaves have their own: ``title_def`` and
  ``page_def`` are k + 1 where the leaf exists, ``box_def`` is k + 2 where the box holds
  its numbers, k + 1 where it is there without them, and k where it isn't.

``assemble`` knows only the stripes. Each entry of the depth-k column with a
repetition level under k begins the children of the next node of depth k-1, so a
running count of these gives the parent's ordinal, and the place since the
last of these gives the child's number; a leaf is read where its definition level says so.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIPES = "record long, key string, depth int, ord int, rep int, def int, node_id string, node_type string, title string, title_def int, page int, page_def int, box array<int>, box_def int"
_INT = re.compile(r"-?\d+(?:\.\d+)?")


def loads(text: str) -> object:
    """``json.loads`` at any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return _loads_deep(text)


def _loads_deep(text: str) -> object:
    """Decodes with a stack of open lists and objects; scalars are left to ``json``."""
    scalar, blanks = json.JSONDecoder().raw_decode, re.compile(r"[ \t\n\r]*")

    def skip(i: int) -> int:
        return blanks.match(text, i).end()

    def name(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("no name")
        key, i = scalar(text, i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("no colon")
        return key, skip(i + 1)

    stack: list[tuple] = []
    i = skip(0)
    while True:
        if (c := text[i : i + 1]) and c in "{[":
            value, i = {} if c == "{" else [], skip(i + 1)
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                key, i = name(i) if c == "{" else (None, i)
                stack.append((value, key))
                continue
            i += 1
        else:
            value, i = scalar(text, i)
        while True:
            i = skip(i)
            if not stack:
                if i != len(text):
                    raise ValueError("more than one value")
                return value
            box, key = stack.pop()
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                key, i = name(i) if isinstance(box, dict) else (None, i)
                stack.append((box, key))
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("not closed")
            value, i = box, i + 1


def box_values(value: object) -> list[int] | None:
    """x1, y1, x2, y2 of a box given as list, object or string; None if it has no four numbers.

    Numbers may be given as strings; fractions are cut to whole numbers.
    """
    if isinstance(value, str):
        s = value.strip()
        if s[:1] in "[{":
            try:
                return box_values(loads(s))
            except ValueError:
                pass
        value = _INT.findall(s)
    elif isinstance(value, dict):
        value = [value.get(k) for k in ("x1", "y1", "x2", "y2")]
    if not isinstance(value, list) or len(value) != 4:
        return None
    try:
        numbers = [int(float(x)) for x in value]
    except (TypeError, ValueError, OverflowError):
        return None
    return numbers if all(abs(x) < 2**31 for x in numbers) else None


def box_text(value: object) -> str:
    """``x1,y1,x2,y2`` of a box, or empty."""
    return ",".join(map(str, box_values(value) or ()))


def as_nodes(value: object) -> list:
    """A list of nodes given as list, one object, or JSON text of either."""
    if isinstance(value, str):
        try:
            value = loads(value)
        except ValueError:
            return []
    if isinstance(value, dict):
        value = [value]
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def find_root(payload: object) -> dict | None:
    """The root node of a decoded payload: under ``structure.root``, in any number of wrappers around it, or the payload itself."""
    while True:  # every turn goes further in
        if isinstance(payload, str):
            try:
                payload = loads(payload)
            except ValueError:
                return None
        if isinstance(payload, list):
            payload = payload[0] if len(payload) == 1 else None
        if not isinstance(payload, dict):
            return None
        if isinstance(payload.get("structure"), (dict, str)):
            payload = payload["structure"]
        elif isinstance(payload.get("root"), (dict, str)):
            payload = payload["root"]
        elif "children" in payload or "type" in payload:
            return payload
        else:
            payload = next((v for k in ("document", "uir", "payload", "data", "body", "doc", "record", "envelope") if (v := payload.get(k)) is not None), None)


def stripes_of(text: str | None) -> list[tuple]:
    """The stripes' entries of one payload, from ``depth`` on; none if it isn't complete JSON."""
    try:
        root = find_root(loads(text)) if text else None
    except ValueError:
        return []
    if root is None:
        return []
    out: list[tuple] = []
    depth, column = 0, [(root, 0, 0)]
    while column:
        below: list[tuple] = []
        for ord_, (node, rep, level) in enumerate(column):
            if node is None:
                out.append((depth, ord_, rep, level, None, None, None, level, None, level, None, level))
                continue
            page, title, box = node.get("page"), node.get("title"), node.get("bounding_box")
            page = page if type(page) is int and abs(page) < 2**31 else None
            title = title if isinstance(title, str) else None
            numbers = box_values(box) if box is not None else None
            box_def = depth if box is None else depth + 1 if numbers is None else depth + 2
            out.append((depth, ord_, rep, depth, node.get("id"), node.get("type"), title, depth + (title is not None), page, depth + (page is not None), numbers, box_def))
            kids = as_nodes(node.get("children"))
            below.extend((kid, rep if j == 0 else depth + 1, depth + 1) for j, kid in enumerate(kids))
            if not kids:
                below.append((None, rep, depth))
        depth, column = depth + 1, below if any(x[0] is not None for x in below) else []
    return out


def shred(records: DataFrame, key: str, payload: str) -> DataFrame:
    """The stripes of every payload, one row per entry (schema ``STRIPES``).

    Null, empty, cut-off and otherwise unreadable payloads give no entries; a
    node without id keeps its place with a null id. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in STRIPES.split(", ")]
        for pdf in batches:
            rows = [(r, k, *s) for r, k, t in zip(pdf["_record"], pdf["_key"], pdf["_payload"]) for s in stripes_of(t)]
            out = pd.DataFrame(rows, columns=names)
            out["page"] = out["page"].astype("Int32")
            for c in ("node_id", "node_type"):
                out[c] = out[c].map(lambda x: x if x is None or isinstance(x, str) else json.dumps(x))
            yield out

    slim = records.select(F.monotonically_increasing_id().alias("_record"), F.col(key).cast("string").alias("_key"), F.col(payload).cast("string").alias("_payload"))
    return slim.mapInPandas(run, STRIPES)


def assemble(stripes: DataFrame) -> DataFrame:
    """Nodes with their parents, from the level sequences alone.

    One row per child node: key, depth, node_id, node_type, title, page, box,
    parent_id, child_no (from 0). A record is one payload, so the windows are as
    large as a payload at most. Everything runs on one shuffle by record.
    """
    w = Window.partitionBy("record", "depth").orderBy("ord")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.col("rep") < F.col("depth")
    placed = stripes.repartition("record").select(
        "*",
        (F.sum(F.when(F.col("def") == F.col("depth"), 1).otherwise(0)).over(upto) - 1).alias("own"),
        (F.sum(F.when(starts, 1).otherwise(0)).over(upto) - 1).alias("above"),
        (F.col("ord") - F.last(F.when(starts, F.col("ord")), ignorenulls=True).over(upto)).cast("long").alias("child_no"),
    ).where(F.col("def") == F.col("depth"))
    # each node stands once as parent, at its own place, and once as child, at its parent's
    sides = placed.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.col("depth").alias("at"), F.col("own").alias("no"), F.lit(-1).cast("long").alias("kid")),
                F.struct((F.col("depth") - 1).alias("at"), F.col("above").alias("no"), F.col("child_no").alias("kid")),
            )
        ).alias("side"),
    ).where((F.col("side.at") >= 0))
    parent = Window.partitionBy("record").orderBy("side.at", "side.no", "side.kid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_parent = F.col("side.kid") < 0
    sides = sides.withColumn("box", F.when(F.col("box_def") == F.col("depth") + 2, F.array_join(F.col("box").cast("array<string>"), ",")).otherwise(""))
    for leaf in ("title", "page"):
        sides = sides.withColumn(leaf, F.when(F.col(f"{leaf}_def") == F.col("depth") + 1, F.col(leaf)))
    return (
        sides.withColumn("parent", F.last(F.when(is_parent, F.struct("node_id")), ignorenulls=True).over(parent))
        .where(~is_parent)
        .select("key", "depth", "node_id", "node_type", "title", "page", "box", F.col("parent.node_id").alias("parent_id"), "child_no")
    )


def flat_nodes(records: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """Every child node of every payload as a flat row linked to its parent.

    Payloads delivered again count once (a node is told by key and id, and nodes
    without id by their place too). An empty table gives an empty one.
    """
    nodes = assemble(shred(records, key, payload))
    return nodes.dropDuplicates(["key", "node_id", "parent_id", "child_no"])


def found(records: DataFrame) -> DataFrame:
    """p5_found: doc_id, node_id, parent_id, child_no, box of every child node, once each."""
    return (
        assemble(shred(records, "doc_id", "payload"))
        .select(F.col("key").alias("doc_id"), "node_id", "parent_id", "child_no", "box")
        .distinct()
    )
