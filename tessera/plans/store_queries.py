"""Queries over memories, lineage, facts and the entity graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fact_index as FI
from tessera.operators import graph as G
from tessera.operators import lineage as L
from tessera.operators import maintenance as A
from tessera.operators import memories as M
from tessera.sources.tables import table
from tessera.streaming.windows import evidence_counts

VERSION = "rules-1.5"
STRUCTURAL_LIMIT = 50


def memory_listing(spark: SparkSession, d: str) -> DataFrame:
    return M.listing(table(spark, d, "memories"), category="preference", min_importance=0.8, keyword="e").select("id", "tenant", "importance", "state")


def memory_access(spark: SparkSession, d: str) -> DataFrame:
    return M.listing(table(spark, d, "memories"), record_access=True).select("id", "access_count", "state")


def memory_top(spark: SparkSession, d: str) -> DataFrame:
    return M.top_by_importance(table(spark, d, "memories"), 5).select("tenant", "rank", "id", "importance")


def memory_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return M.exact_duplicates(table(spark, d, "memories"), L.historical_ids(table(spark, d, "memory_relationships")))


def memory_merges(spark: SparkSession, d: str) -> DataFrame:
    return M.merged_groups(table(spark, d, "memories")).withColumn("confidence", F.round("confidence", 6))


def memory_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = M.buckets(table(spark, d, "memories"), 10)
    return b.select("tenant", *[F.array_join(c, "|").alias(c) for c in ("profile", "preferences", "habits", "events", "other")])


def memory_violations(spark: SparkSession, d: str) -> DataFrame:
    return M.violations(table(spark, d, "memories"))


def memory_reflection(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "memory_evidence").where("decision = 'reinforcement' OR decision = 'REINFORCEMENT'").select("memory_id")
    return M.reflected(table(spark, d, "memories"), used).select("id", "access_count", F.round("importance", 6).alias("importance"))


def lineage_historical(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").select(F.col("id").alias("memory_id"), "state")
    return m.join(L.historical_ids(table(spark, d, "memory_relationships")), "memory_id", "left_semi")


def lineage_distinct(spark: SparkSession, d: str) -> DataFrame:
    return L.distinct_links(table(spark, d, "memory_relationships"))


def lineage_dangling(spark: SparkSession, d: str) -> DataFrame:
    return L.dangling(table(spark, d, "memory_relationships"), table(spark, d, "memories"))


def lineage_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.pairs_with_contents(table(spark, d, "memory_relationships"), table(spark, d, "memories"))


def lineage_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return L.contradictions(table(spark, d, "memories"))


def lineage_degrees(spark: SparkSession, d: str) -> DataFrame:
    return L.links_per_memory(table(spark, d, "memory_relationships"))


def evidence_view(spark: SparkSession, d: str) -> DataFrame:
    return L.evidence_view(table(spark, d, "memory_evidence"), table(spark, d, "memories"), table(spark, d, "memory_relationships"))


def index_current(spark: SparkSession, d: str) -> DataFrame:
    return FI.current(table(spark, d, "knowledge_facts")).select("memory_id", "updated_at", "tenant", "entity_key", "attribute_key", "value_key")


def index_candidates(spark: SparkSession, d: str) -> DataFrame:
    h = L.historical_ids(table(spark, d, "memory_relationships"))
    return FI.structural_candidates(FI.current(table(spark, d, "knowledge_facts")), table(spark, d, "memories"), h, STRUCTURAL_LIMIT)


def index_live_counts(spark: SparkSession, d: str) -> DataFrame:
    h = L.historical_ids(table(spark, d, "memory_relationships"))
    return FI.live_fact_counts(FI.current(table(spark, d, "knowledge_facts")), table(spark, d, "memories"), h)


def index_status(spark: SparkSession, d: str) -> DataFrame:
    return FI.upkeep(FI.current(table(spark, d, "knowledge_facts")), table(spark, d, "memories"), VERSION)


def index_counts(spark: SparkSession, d: str) -> DataFrame:
    return FI.upkeep_counts(index_status(spark, d))


def graph_resolved(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "knowledge_facts").select("entity_key").where("entity_key IS NOT NULL").distinct()
    return G.resolve(f, "entity_key", table(spark, d, "entities"), table(spark, d, "entity_aliases"))


def graph_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").where("content IS NOT NULL")
    return G.entities_in(m, "id", "content", table(spark, d, "entities"), table(spark, d, "entity_aliases")).select("id", "entity_id")


def graph_links(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_memories(table(spark, d, "memory_entities"))


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(table(spark, d, "memory_entities"))


def graph_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Entities without memory, alias and typed edge."""
    return G.orphans(table(spark, d, "entities"), table(spark, d, "memory_entities"), graph_edges(spark, d), table(spark, d, "entity_aliases"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.typed_edges(table(spark, d, "knowledge_facts"), table(spark, d, "entities"))


def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(table(spark, d, "memory_entities"))


def conflict_report(spark: SparkSession, d: str) -> DataFrame:
    return A.conflict_report(table(spark, d, "memories"), table(spark, d, "knowledge_facts"), table(spark, d, "memory_relationships"))


def legacy_evidence(spark: SparkSession, d: str) -> DataFrame:
    return A.legacy_evidence(table(spark, d, "memories"), table(spark, d, "memory_evidence")).select("memory_id", "observed_at", "decision")


PURGED = ("memories", "memory_relationships", "memory_evidence", "knowledge_facts", "memory_entities", "entities", "entity_aliases")


def _purged(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables without the archived memories; an edge hangs on the memory whose fact states it."""
    t = {n: table(spark, d, n) for n in PURGED}
    return A.purged(t, t["memories"].where("state = 'archived'"), edges=G.stated_edges(FI.current(t["knowledge_facts"]), t["entities"]))


def purge_effect(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table that stay when the archived memories are purged, and the sum of the versions."""
    out = _purged(spark, d)
    counts = [out[n].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in (*PURGED, "edges")]
    counts.append(out["memories"].agg(F.sum("version").alias("rows")).select(F.lit("versions").alias("name"), "rows"))
    for c in counts[1:]:
        counts[0] = counts[0].unionByName(c)
    return counts[0]


def purge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What the memories that stay lose when the archived ones are purged."""
    return _purged(spark, d)["evidence"].select("memory_id", "decision", F.array_join("reason_codes", ",").alias("reason_codes"))


def graph_reachable(spark: SparkSession, d: str) -> DataFrame:
    """Names within reach of every entity whose id is divisible by 20, over typed edges in either direction."""
    e = table(spark, d, "entities").select("id", "normalized_name")
    t = graph_edges(spark, d).join(e.select(F.col("id").alias("source_id"), F.col("normalized_name").alias("source")), "source_id").join(e.select(F.col("id").alias("target_id"), F.col("normalized_name").alias("target")), "target_id")
    return G.expanded(t, e.where("id % 20 = 0").select(F.col("normalized_name").alias("name")))


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Memories of the entities that are named exactly as the facts name their subjects."""
    k = table(spark, d, "knowledge_facts").select(F.col("entity_key").alias("keyword")).where("keyword IS NOT NULL").distinct()
    return G.node_search(table(spark, d, "entities"), table(spark, d, "memory_entities"), k)


def evidence_by_day(spark: SparkSession, d: str) -> DataFrame:
    c = evidence_counts(table(spark, d, "memory_evidence").where("observed_at IS NOT NULL"))
    return c.select(F.col("window.start").alias("day"), "source_type", "rows")


QUERIES = {f.__name__: f for f in (memory_listing, memory_access, memory_top, memory_duplicates, memory_merges, memory_buckets, memory_violations, memory_reflection, lineage_historical, lineage_distinct, lineage_dangling, lineage_pairs, lineage_contradictions, lineage_degrees, evidence_view, index_current, index_candidates, index_live_counts, index_status, index_counts, graph_resolved, graph_mentions, graph_links, graph_degrees, graph_orphans, graph_edges, graph_closure, conflict_report, legacy_evidence, purge_effect, purge_evidence, graph_reachable, graph_nodes, evidence_by_day)}

_T = r"regexp_replace(lower(regexp_replace(relationship_type, '^\s+|\s+$', '', 'g')), '[-_\s]+', '_', 'g')"
_HIST = f"hist AS (SELECT DISTINCT source_memory_id AS memory_id FROM memory_relationships WHERE {_T} IN ('superseded_by', 'fulfilled_by') AND source_memory_id IS NOT NULL)"
_LINKS = f"l AS (SELECT source_memory_id, target_memory_id, {_T} AS relationship_type, min(id) AS id FROM memory_relationships WHERE source_memory_id IS NOT NULL AND target_memory_id IS NOT NULL AND source_memory_id <> target_memory_id GROUP BY 1, 2, 3)"
_DERIVED = "updated_at, tenant, entity_key, attribute_key, value_key, value_text, fact_type, single_valued, temporal_state, is_negated, is_placeholder, confidence, content_sha256, extractor_version"
_CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY " + ", ".join(f"{c} DESC NULLS LAST" for c in _DERIVED.split(", ")) + ") AS rn FROM knowledge_facts WHERE memory_id IS NOT NULL) x WHERE rn = 1)"
_USABLE = "use AS (SELECT cur.* FROM cur JOIN memories m ON m.id = cur.memory_id WHERE m.state <> 'archived' AND NOT coalesce(m.is_contradicted, false) AND NOT coalesce(cur.is_placeholder, false) AND cur.memory_id NOT IN (SELECT memory_id FROM hist))"
_STATUS = f"st AS (SELECT coalesce(c.memory_id, m.id) AS memory_id, CASE WHEN m.id IS NULL OR m.content IS NULL THEN 'unexpected' WHEN c.content_sha256 IS NULL THEN 'missing' WHEN c.content_sha256 <> sha256(m.content) OR c.extractor_version <> '{VERSION}' THEN 'stale' ELSE 'unchanged' END AS status FROM cur c FULL JOIN memories m ON m.id = c.memory_id)"
_TOP = "SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY importance DESC NULLS LAST, id) AS rank FROM memories WHERE state <> 'archived'"
_NAMES = "nm AS (SELECT normalized_name AS name, min(id) AS entity_id FROM entities WHERE normalized_name IS NOT NULL GROUP BY 1), al AS (SELECT alias_normalized AS name, min(entity_id) AS entity_id FROM entity_aliases WHERE alias_normalized NOT IN (SELECT name FROM nm) GROUP BY 1), names AS (SELECT * FROM nm UNION ALL SELECT * FROM al)"
_EDGE = "[.,!?;:\"''()\\[\\]{}]+"
_DET = "('a', 'an', 'the', 'my', 'our', 'your', 'his', 'her', 'their', 'its', 'this', 'that', 'these', 'those', 'every', 'each', 'some', 'any')"
_TYPED = "te AS (SELECT DISTINCT s.id AS source_id, t.id AS target_id FROM knowledge_facts f JOIN entities s ON s.normalized_name = f.entity_key JOIN entities t ON t.normalized_name = lower(trim(f.value_key)) WHERE NOT coalesce(is_placeholder, false) AND s.id <> t.id)"


def _name_sql(c: str) -> str:
    words = f"list_filter(list_transform(regexp_split_to_array(lower(regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')), '\\s+'), lambda x: regexp_replace(x, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda x: x <> '')"
    first = f"list_filter(range(1, len({words}) + 1), lambda i: ({words})[i] NOT IN {_DET})[1]"
    return f"CASE WHEN {first} IS NULL THEN '' ELSE regexp_replace(array_to_string(({words})[{first}:], ' '), '''s$', '') END"


_PURGED = f"""{_CURRENT}, g AS (SELECT id FROM memories WHERE state = 'archived'), me AS (SELECT * FROM memory_entities WHERE memory_id IS NULL OR memory_id NOT IN (SELECT id FROM g)),
ed AS (SELECT DISTINCT s.id AS source_id, t.id AS target_id, attribute_key, memory_id FROM cur f JOIN entities s ON s.normalized_name = f.entity_key JOIN entities t ON t.normalized_name = lower(trim(f.value_key)) WHERE NOT coalesce(is_placeholder, false) AND s.id <> t.id AND memory_id NOT IN (SELECT id FROM g)),
lost AS (SELECT * FROM (SELECT source_memory_id AS memory_id, target_memory_id AS purged, {_T} || ':outgoing' AS code FROM memory_relationships WHERE target_memory_id IN (SELECT id FROM g)
 UNION ALL SELECT target_memory_id, source_memory_id, {_T} || ':incoming' FROM memory_relationships WHERE source_memory_id IN (SELECT id FROM g)
 UNION ALL SELECT id, contradicted_by_id, 'contradicted_by:outgoing' FROM memories WHERE contradicted_by_id IN (SELECT id FROM g)) WHERE memory_id IS NOT NULL AND memory_id NOT IN (SELECT id FROM g))"""
_STATE = "CASE WHEN CASE WHEN coalesce(access_count, 0) + 1 >= 3 THEN 'active' ELSE 'weak' END = 'active' AND coalesce(importance, 0) < 0.5 AND coalesce(access_count, 0) + 1 < 3 THEN 'weak' WHEN coalesce(access_count, 0) + 1 >= 3 THEN 'active' ELSE 'weak' END"

SQL = {
    "memory_listing": "SELECT id, tenant, importance, state FROM memories WHERE state <> 'archived' AND category = 'preference' AND importance >= 0.8 AND content ILIKE '%e%'",
    "memory_access": f"SELECT id, coalesce(access_count, 0) + 1 AS access_count, {_STATE} AS state FROM memories WHERE state <> 'archived'",
    "memory_top": f"SELECT tenant, rank, id, importance FROM ({_TOP}) WHERE rank <= 5",
    "memory_duplicates": f"WITH {_HIST}, g AS (SELECT tenant, content, min(CASE WHEN state <> 'archived' OR state IS NULL THEN id END) AS a, min(id) AS b, count(*) AS copies FROM memories WHERE content IS NOT NULL AND id NOT IN (SELECT memory_id FROM hist) GROUP BY 1, 2) SELECT tenant, content, coalesce(a, b) AS keeper, copies FROM g WHERE copies > 1",
    "memory_merges": "SELECT tenant, lower(trim(content)) AS content, round(least(1.0, max(confidence) + 0.05::DOUBLE), 6) AS confidence, CAST(sum(access_count) + 1 AS BIGINT) AS access_count, min(created_at) AS created_at, count(*) AS rows FROM memories WHERE content IS NOT NULL GROUP BY 1, 2",
    "memory_buckets": f"SELECT tenant, coalesce(string_agg(content, '|' ORDER BY rank) FILTER (WHERE category = 'profile'), '') AS profile, coalesce(string_agg(content, '|' ORDER BY rank) FILTER (WHERE category = 'preference'), '') AS preferences, coalesce(string_agg(content, '|' ORDER BY rank) FILTER (WHERE category = 'habit'), '') AS habits, coalesce(string_agg(content, '|' ORDER BY rank) FILTER (WHERE category = 'event'), '') AS events, coalesce(string_agg(content, '|' ORDER BY rank) FILTER (WHERE coalesce(category, '') NOT IN ('profile', 'preference', 'habit', 'event')), '') AS other FROM ({_TOP}) WHERE rank <= 10 GROUP BY tenant",
    "memory_violations": """SELECT 'state' AS "check", count(*) AS rows FROM memories WHERE state NOT IN ('active', 'weak', 'archived') UNION ALL SELECT 'self_contradiction', count(*) FROM memories WHERE contradicted_by_id = id
UNION ALL SELECT 'embedding_width', count(*) FROM memories WHERE len(embedding) <> 64 UNION ALL SELECT 'content_missing', count(*) FROM memories WHERE content IS NULL""",
    "memory_reflection": "WITH u AS (SELECT DISTINCT memory_id FROM memory_evidence WHERE decision IN ('reinforcement', 'REINFORCEMENT')) SELECT m.id, coalesce(access_count, 0) + (u.memory_id IS NOT NULL)::INTEGER AS access_count, round(CASE WHEN u.memory_id IS NOT NULL THEN least(1.0, coalesce(importance, 0.5) + 0.02::DOUBLE) ELSE importance END, 6) AS importance FROM memories m LEFT JOIN u ON u.memory_id = m.id",
    "lineage_historical": f"WITH {_HIST} SELECT id AS memory_id, state FROM memories WHERE id IN (SELECT memory_id FROM hist)",
    "lineage_distinct": f"WITH {_LINKS} SELECT source_memory_id, target_memory_id, relationship_type, id FROM l",
    "lineage_dangling": f"SELECT {_T} AS relationship_type, count(*) AS links FROM memory_relationships WHERE target_memory_id IS NOT NULL AND target_memory_id NOT IN (SELECT id FROM memories) GROUP BY 1",
    "lineage_pairs": f"WITH {_LINKS} SELECT relationship_type, source_memory_id, target_memory_id, s.content AS source, t.content AS target FROM l LEFT JOIN memories s ON s.id = source_memory_id LEFT JOIN memories t ON t.id = target_memory_id WHERE relationship_type IN ('superseded_by', 'merged_into', 'fulfilled_by')",
    "lineage_contradictions": "SELECT m.id AS memory_id, m.contradicted_by_id, m.content, b.content AS by_content FROM memories m LEFT JOIN memories b ON b.id = m.contradicted_by_id WHERE coalesce(m.is_contradicted, false)",
    "lineage_degrees": f"WITH {_LINKS} SELECT memory_id, relationship_type, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (SELECT source_memory_id AS memory_id, relationship_type, 1 AS o, 0 AS i FROM l UNION ALL SELECT target_memory_id, relationship_type, 0, 1 FROM l) GROUP BY 1, 2",
    "evidence_view": f"""WITH {_LINKS}, p AS (SELECT relationship_type, source_memory_id, target_memory_id, s.content AS source, t.content AS target FROM l LEFT JOIN memories s ON s.id = source_memory_id LEFT JOIN memories t ON t.id = target_memory_id WHERE relationship_type IN ('superseded_by', 'merged_into', 'fulfilled_by')),
x AS (SELECT DISTINCT memory_id, 'evidence' AS kind, observed_at AS at, id AS ref, decision, '' AS other_content FROM memory_evidence UNION ALL SELECT source_memory_id, 'outgoing', NULL, target_memory_id, relationship_type, coalesce(target, '') FROM p UNION ALL SELECT target_memory_id, 'incoming', NULL, source_memory_id, relationship_type, coalesce(source, '') FROM p)
SELECT * FROM x WHERE memory_id IN (SELECT id FROM memories WHERE state <> 'archived')""",
    "index_current": f"WITH {_CURRENT} SELECT memory_id, updated_at, tenant, entity_key, attribute_key, value_key FROM cur",
    "index_candidates": f"""WITH {_HIST}, {_CURRENT}, {_USABLE}, r AS (SELECT *, CASE WHEN coalesce(single_valued, false) THEN '' ELSE value_key END AS domain_value FROM use),
k AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY tenant, entity_key, attribute_key, domain_value) AS n FROM r WINDOW w AS (PARTITION BY tenant, entity_key, attribute_key, domain_value ORDER BY memory_id DESC))
SELECT k.tenant, entity_key, attribute_key, domain_value, memory_id, rank, n > {STRUCTURAL_LIMIT} AS truncated, coalesce(content_sha256 = sha256(m.content), false) AS supported FROM k JOIN memories m ON m.id = memory_id WHERE rank <= {STRUCTURAL_LIMIT}""",
    "index_live_counts": f"WITH {_HIST}, {_CURRENT}, {_USABLE} SELECT tenant, entity_key, attribute_key, value_key, count(*) AS memories FROM use GROUP BY 1, 2, 3, 4",
    "index_status": f"WITH {_CURRENT}, {_STATUS} SELECT memory_id, status FROM st",
    "index_counts": f"WITH {_CURRENT}, {_STATUS} SELECT status, count(*) AS memories FROM st GROUP BY 1",
    "graph_resolved": f"""WITH {_NAMES}, f AS (SELECT DISTINCT entity_key FROM knowledge_facts WHERE entity_key IS NOT NULL),
w AS (SELECT entity_key, list_filter(list_transform(regexp_split_to_array(lower(regexp_replace(entity_key, '^\\s+|\\s+$', '', 'g')), '\\s+'), lambda x: regexp_replace(x, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda x: x <> '') AS w FROM f),
k AS (SELECT entity_key, w, list_filter(range(1, len(w) + 1), lambda i: w[i] NOT IN {_DET})[1] AS first FROM w)
SELECT entity_key, entity_id FROM k LEFT JOIN names ON names.name = CASE WHEN first IS NULL THEN '' ELSE regexp_replace(array_to_string(w[first:], ' '), '''s$', '') END""",
    "graph_mentions": f"""WITH RECURSIVE {_NAMES}, w AS (SELECT id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_''-]+') AS w FROM memories WHERE content IS NOT NULL),
n AS (SELECT id, w, unnest(range(1, least(5, len(w)) + 1)) AS words FROM w), p AS (SELECT id, w, words, unnest(range(1, len(w) - words + 2)) AS start FROM n),
s AS (SELECT id, words, min(start) AS start, array_to_string(w[start:start + words - 1], ' ') AS name FROM p GROUP BY id, words, array_to_string(w[start:start + words - 1], ' ')),
h AS (SELECT s.*, entity_id, row_number() OVER (PARTITION BY id ORDER BY words DESC, start) AS k FROM s JOIN names ON names.name = s.name WHERE s.name <> 'user'),
f AS (SELECT id, 1 AS k, [start] AS st, [start + words] AS en, [entity_id] AS e FROM h WHERE k = 1
 UNION ALL SELECT f.id, h.k, CASE WHEN ok THEN list_append(f.st, h.start) ELSE f.st END, CASE WHEN ok THEN list_append(f.en, h.start + h.words) ELSE f.en END, CASE WHEN ok THEN list_append(f.e, h.entity_id) ELSE f.e END
 FROM (SELECT f.id, f.k AS fk, f.st, f.en, f.e, h.k, h.start, h.words, h.entity_id, len(list_filter(range(1, len(f.st) + 1), lambda i: NOT (f.en[i] <= h.start OR h.start + h.words <= f.st[i]))) = 0 AS ok FROM f JOIN h ON h.id = f.id AND h.k = f.k + 1) j, LATERAL (SELECT j.id, j.k, j.start, j.words, j.entity_id) h, LATERAL (SELECT j.id, j.st, j.en, j.e) f)
SELECT DISTINCT id, unnest(e) AS entity_id FROM (SELECT id, e, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS r FROM f) WHERE r = 1""",
    "graph_links": "SELECT memory_id, entity_id, CASE min(CASE role WHEN 'subject' THEN 0 WHEN 'value' THEN 1 WHEN 'mention' THEN 2 ELSE 3 END) WHEN 0 THEN 'subject' WHEN 1 THEN 'value' WHEN 2 THEN 'mention' END AS role FROM memory_entities WHERE memory_id IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1, 2",
    "graph_degrees": "SELECT entity_id, count(DISTINCT memory_id) AS memories FROM memory_entities WHERE memory_id IS NOT NULL AND entity_id IS NOT NULL GROUP BY 1",
    "graph_orphans": f"WITH {_TYPED} SELECT id FROM entities WHERE id NOT IN (SELECT entity_id FROM memory_entities WHERE entity_id IS NOT NULL) AND id NOT IN (SELECT entity_id FROM entity_aliases WHERE entity_id IS NOT NULL) AND id NOT IN (SELECT source_id FROM te) AND id NOT IN (SELECT target_id FROM te)",
    "graph_reachable": f"""WITH RECURSIVE {_TYPED}, b AS (SELECT s.normalized_name AS x, t.normalized_name AS y FROM te JOIN entities s ON s.id = source_id JOIN entities t ON t.id = target_id), bb AS (SELECT x, y FROM b UNION SELECT y, x FROM b),
r AS (SELECT normalized_name AS start, normalized_name AS name, 0 AS hops FROM entities WHERE id % 20 = 0 AND normalized_name IS NOT NULL UNION SELECT r.start, bb.y, r.hops + 1 FROM r JOIN bb ON bb.x = r.name WHERE r.hops < 64) SELECT start, name, min(hops) AS hops FROM r GROUP BY 1, 2""",
    "graph_nodes": f"""WITH k AS (SELECT DISTINCT entity_key AS keyword, {_name_sql('entity_key')} AS key FROM knowledge_facts WHERE entity_key IS NOT NULL), e AS (SELECT id AS entity_id, {_name_sql('normalized_name')} AS key FROM entities UNION SELECT id, {_name_sql('display_name')} FROM entities),
f AS (SELECT DISTINCT keyword, entity_id FROM k JOIN e USING (key) WHERE key <> '') SELECT DISTINCT keyword, f.entity_id, m.memory_id FROM f LEFT JOIN memory_entities m ON m.entity_id = f.entity_id""",
    "graph_closure": """WITH RECURSIVE l AS (SELECT DISTINCT memory_id, entity_id FROM memory_entities WHERE memory_id IS NOT NULL AND entity_id IS NOT NULL),
h AS (SELECT memory_id, min(entity_id) AS hub FROM l GROUP BY 1), e AS (SELECT DISTINCT hub AS a, entity_id AS b FROM l JOIN h USING (memory_id)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS s, a AS t FROM u UNION SELECT r.s, u.b FROM r JOIN u ON u.a = r.t) SELECT s AS entity_id, min(t) AS component FROM r GROUP BY 1""",
    "graph_edges": "SELECT DISTINCT s.id AS source_id, t.id AS target_id, attribute_key AS relationship FROM knowledge_facts f JOIN entities s ON s.normalized_name = f.entity_key JOIN entities t ON t.normalized_name = lower(trim(f.value_key)) WHERE NOT coalesce(is_placeholder, false) AND s.id <> t.id",
    "conflict_report": f"WITH {_HIST}, {_CURRENT} SELECT tenant, entity_key, attribute_key, count(DISTINCT value_key) AS values FROM cur WHERE single_valued AND NOT is_placeholder AND NOT is_negated AND temporal_state = 'CURRENT' AND memory_id IN (SELECT id FROM memories WHERE state <> 'archived' AND NOT coalesce(is_contradicted, false)) AND memory_id NOT IN (SELECT memory_id FROM hist) GROUP BY 1, 2, 3 HAVING count(DISTINCT value_key) > 1",
    "legacy_evidence": "SELECT id AS memory_id, created_at AS observed_at, 'LEGACY' AS decision FROM memories WHERE id NOT IN (SELECT memory_id FROM memory_evidence WHERE memory_id IS NOT NULL)",
    "purge_effect": f"""WITH {_PURGED}
SELECT 'memories' AS name, count(*) AS rows FROM memories WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'memory_relationships', count(*) FROM memory_relationships WHERE coalesce(source_memory_id NOT IN (SELECT id FROM g), true) AND coalesce(target_memory_id NOT IN (SELECT id FROM g), true)
UNION ALL SELECT 'memory_evidence', count(*) FROM memory_evidence WHERE coalesce(memory_id NOT IN (SELECT id FROM g), true)
UNION ALL SELECT 'knowledge_facts', count(*) FROM knowledge_facts WHERE coalesce(memory_id NOT IN (SELECT id FROM g), true)
UNION ALL SELECT 'memory_entities', count(*) FROM me UNION ALL SELECT 'edges', count(*) FROM ed
UNION ALL SELECT 'entities', count(*) FROM entities WHERE id IN (SELECT entity_id FROM me) OR id IN (SELECT entity_id FROM entity_aliases) OR id IN (SELECT source_id FROM ed) OR id IN (SELECT target_id FROM ed)
UNION ALL SELECT 'entity_aliases', count(*) FROM entity_aliases
UNION ALL SELECT 'versions', CAST((SELECT sum(version) FROM memories WHERE id NOT IN (SELECT id FROM g)) + (SELECT count(*) FROM (SELECT DISTINCT memory_id, purged FROM lost)) AS BIGINT)""",
    "purge_evidence": f"WITH {_PURGED} SELECT memory_id, 'lineage_removed_by_purge' AS decision, 'purged_memory:' || purged || ',' || string_agg(code, ',' ORDER BY code) AS reason_codes FROM lost GROUP BY memory_id, purged",
    "evidence_by_day": "SELECT time_bucket(INTERVAL 1 DAY, observed_at) AS day, source_type, count(*) AS rows FROM memory_evidence WHERE observed_at IS NOT NULL GROUP BY 1, 2",
}
