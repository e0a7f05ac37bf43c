"""Registered core queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheafline.operators import shred
from sheafline.plans import ingestion, pages, relations, retrieval
from sheafline.session import read

P5_SQL = """
with recursive docs as (select distinct doc_id, payload::json as j from uir_raw where json_valid(payload)),
roots as (select doc_id, case when json_type(j, '$.structure.root') = 'OBJECT' then j->'$.structure.root' else j->'$.structure' end as node from docs),
nodes as (
  select doc_id, node, node->>'$.id' as node_id, null::varchar as parent_id, 0::bigint as child_no, 0 as depth from roots where node is not null
  union all
  select doc_id, kid, kid->>'$.id', node_id, (no - 1)::bigint, depth + 1 from (
    select doc_id, node_id, depth, unnest(kids) as kid, generate_subscripts(kids, 1) as no from (
      select doc_id, node_id, depth, (case json_type(node, '$.children') when 'ARRAY' then node->'$.children' when 'VARCHAR' then (node->>'$.children')::json end)::json[] as kids from nodes))),
b as (select *, node->'$.bounding_box' as bb, json_type(node, '$.bounding_box') as k from nodes where depth > 0)
select distinct doc_id, node_id, parent_id, child_no, case k
  when 'OBJECT' then (bb->>'$.x1') || ',' || (bb->>'$.y1') || ',' || (bb->>'$.x2') || ',' || (bb->>'$.y2')
  when 'ARRAY' then (bb->>0) || ',' || (bb->>1) || ',' || (bb->>2) || ',' || (bb->>3)
  when 'VARCHAR' then array_to_string(regexp_extract_all(bb->>'$', '-?[0-9]+'), ',') else '' end as box from b
"""

_MODULES = (retrieval, pages, relations, ingestion)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {"p5_found": lambda s, d: shred.found(read(s, d, "uir_raw"))}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {"p5_found": P5_SQL}
    for m in _MODULES:
        out |= m.SQL
    return out
