"""Queries of the general problems (hierarchies, attribute history) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hierarchy, history
from tessera.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchies(table(spark, d, "memory_relationships")).drop("cycle")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchies(table(spark, d, "memory_relationships")))


def p4_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Each memory on a circle of links, with the ids of its circle."""
    h = hierarchy.hierarchies(table(spark, d, "memory_relationships")).where("cycle IS NOT NULL")
    return h.select("relationship_type", "memory_id", F.array_join("cycle", "/").alias("cycle"))


def p4_other_parents(spark: SparkSession, d: str) -> DataFrame:
    """Links to parents beside the one by which a memory's path goes."""
    return hierarchy.other_parents(table(spark, d, "memory_relationships"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.versions(table(spark, d, "knowledge_facts")).select("tenant", "entity_key", "attribute_key", "opened_by", "closed_by")


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    return history.versions(table(spark, d, "knowledge_facts"))


QUERIES = {"p4_found": p4_found, "p4_descendants": p4_descendants, "p4_cycles": p4_cycles, "p4_other_parents": p4_other_parents, "p5_found": p5_found, "p5_history": p5_history}

_TREE = r"""
WITH RECURSIVE e AS (
  SELECT relationship_type, child, min(parent) AS parent FROM (
    SELECT regexp_replace(lower(regexp_replace(relationship_type, '^\s+|\s+$', '', 'g')), '[-_\s]+', '_', 'g') AS relationship_type,
           source_memory_id AS child, target_memory_id AS parent FROM memory_relationships) x
  WHERE relationship_type IN ('superseded_by', 'merged_into', 'fulfilled_by') AND child IS NOT NULL AND parent IS NOT NULL
  GROUP BY 1, 2),
n AS (SELECT relationship_type, child AS memory_id FROM e UNION SELECT relationship_type, parent FROM e),
t AS (
  SELECT n.relationship_type, n.memory_id, n.memory_id AS root_id, 0 AS depth, CAST(n.memory_id AS VARCHAR) AS path
  FROM n LEFT JOIN e ON n.relationship_type = e.relationship_type AND n.memory_id = e.child WHERE e.child IS NULL
  UNION ALL
  SELECT t.relationship_type, e.child, t.root_id, t.depth + 1, t.path || '/' || e.child
  FROM t JOIN e ON t.relationship_type = e.relationship_type AND t.memory_id = e.parent)
"""

_LOG = r"""
WITH f AS (
  SELECT memory_id, min(struct_pack(u := updated_at, t := tenant, e := entity_key, a := attribute_key, v := value_text,
         s := coalesce(temporal_state, ''), n := coalesce(is_negated, false))) AS r
  FROM knowledge_facts
  WHERE coalesce(single_valued, false) AND NOT coalesce(is_placeholder, false) AND memory_id IS NOT NULL AND updated_at IS NOT NULL
  GROUP BY memory_id),
x AS (
  SELECT memory_id, r.u AS updated_at, r.t AS tenant, r.e AS entity_key, r.a AS attribute_key, r.v AS value_text, r.n AS negated,
         regexp_replace(regexp_replace(lower(r.v), '[\s.,;:!]+$', ''), '\s+', '', 'g') AS k
  FROM f WHERE r.v IS NOT NULL AND (r.n OR r.s = 'CURRENT')),
y AS (
  SELECT *, last_value(CASE WHEN NOT negated THEN k END IGNORE NULLS) OVER (PARTITION BY tenant, entity_key, attribute_key
         ORDER BY updated_at, memory_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stated FROM x),
z AS (
  SELECT *, lag(k) OVER w AS pk, lag(negated) OVER w AS pn FROM y WHERE NOT negated OR k = stated
  WINDOW w AS (PARTITION BY tenant, entity_key, attribute_key ORDER BY updated_at, memory_id)),
l AS (
  SELECT * FROM z WHERE (NOT negated AND (pk IS NULL OR pn OR pk <> k)) OR (negated AND NOT pn)),
v AS (
  SELECT *, lead(memory_id) OVER w AS next_id, lead(updated_at) OVER w AS next_at, lead(negated) OVER w AS next_negated FROM l
  WINDOW w AS (PARTITION BY tenant, entity_key, attribute_key ORDER BY updated_at, memory_id))
"""

SQL = {
    "p4_found": _TREE
    + """SELECT n.relationship_type, n.memory_id, coalesce(t.root_id, -1) AS root_id, coalesce(t.depth, -1) AS depth, coalesce(t.path, '') AS path
FROM n LEFT JOIN t ON n.relationship_type = t.relationship_type AND n.memory_id = t.memory_id""",
    "p4_cycles": _TREE
    + """, w AS (SELECT relationship_type, child AS memory_id, parent AS up, [child] AS seen FROM e
  UNION ALL SELECT w.relationship_type, w.memory_id, e.parent, list_append(w.seen, w.up) FROM w JOIN e ON e.relationship_type = w.relationship_type AND e.child = w.up WHERE NOT list_contains(w.seen, w.up))
SELECT relationship_type, memory_id, array_to_string(list_sort(seen), '/') AS cycle FROM w WHERE up = memory_id""",
    "p4_other_parents": r"""WITH x AS (SELECT DISTINCT regexp_replace(lower(regexp_replace(relationship_type, '^\s+|\s+$', '', 'g')), '[-_\s]+', '_', 'g') AS relationship_type, source_memory_id AS child, target_memory_id AS parent FROM memory_relationships)
SELECT relationship_type, child, parent FROM x WHERE relationship_type IN ('superseded_by', 'merged_into', 'fulfilled_by') AND child IS NOT NULL AND parent IS NOT NULL
QUALIFY parent > min(parent) OVER (PARTITION BY relationship_type, child)""",
    "p4_descendants": _TREE
    + """, d AS (
  SELECT relationship_type, memory_id, memory_id AS descendant_id, 0 AS distance FROM t
  UNION ALL
  SELECT d.relationship_type, d.memory_id, e.child, d.distance + 1
  FROM d JOIN e ON d.relationship_type = e.relationship_type AND d.descendant_id = e.parent)
SELECT relationship_type, memory_id, descendant_id, distance FROM d WHERE distance > 0""",
    "p5_found": _LOG + "SELECT tenant, entity_key, attribute_key, memory_id AS opened_by, coalesce(next_id, -1) AS closed_by FROM v WHERE NOT negated",
    "p5_history": _LOG
    + """, c AS (SELECT tenant, entity_key, attribute_key, count(*) AS n FROM l GROUP BY 1, 2, 3), r AS (SELECT attribute_key, sum(n) / count(*) - 1 AS rate FROM c GROUP BY 1)
SELECT v.tenant, v.entity_key, v.attribute_key, value_text, memory_id AS opened_by, updated_at AS valid_from, coalesce(next_id, -1) AS closed_by,
  next_at AS valid_to, CASE WHEN next_id IS NOT NULL THEN CASE WHEN next_negated THEN 'negated' ELSE 'restated' END END AS closed_how,
  CASE WHEN rate >= (SELECT quantile_cont(rate, 0.5) FROM r) THEN 'fast' ELSE 'slow' END AS satellite
FROM v JOIN r ON r.attribute_key IS NOT DISTINCT FROM v.attribute_key WHERE NOT negated""",
}
