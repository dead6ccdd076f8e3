"""Queries of retrieval and context building for a table of questions, with their SQL.

The questions are the memories whose id is divisible by 20: their content is asked within their tenant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import extraction
from tessera.functions import text as X
from tessera.operators import context as C
from tessera.operators import evaluation as E
from tessera.operators import fact_index as FI
from tessera.operators import graph as G
from tessera.operators import lineage as L
from tessera.operators import retrieval as R
from tessera.plans import store_queries as SQ
from tessera.plans import text_queries as TQ
from tessera.sources.tables import table


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").where("id % 20 = 0 AND content IS NOT NULL").select(F.col("id").alias("query_id"), "tenant", F.col("content").alias("query"), "embedding")


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    return R.semantic_pool(questions(spark, d), table(spark, d, "memories")).withColumn("distance", F.round("distance", 6))


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_pool(questions(spark, d), table(spark, d, "memories"))


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    return R.graph_pool(questions(spark, d), table(spark, d, "entities"), table(spark, d, "entity_aliases"), table(spark, d, "memory_entities"), table(spark, d, "memories"))


def _candidates(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    return R.candidates(questions(spark, d) if asked is None else asked, table(spark, d, "memories"), table(spark, d, "entities"), table(spark, d, "entity_aliases"), table(spark, d, "memory_entities"), TQ.AS_OF)


def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return c.select("query_id", "memory_id", "rank", F.round("score", 6).alias("score"), F.round("lexical_score", 6).alias("lexical"), "reasons")


def _selected(spark: SparkSession, d: str, q: DataFrame, facts: DataFrame, named: DataFrame) -> DataFrame:
    """The context of questions; those about the past see archived memories."""
    q = q.withColumn("past", X.temporal_intent(F.col("query")) == "HISTORICAL")
    index = FI.current(table(spark, d, "knowledge_facts"))
    return C.build(_candidates(spark, d, q), index, L.historical_ids(table(spark, d, "memory_relationships")), facts, named)


def _context(spark: SparkSession, d: str) -> DataFrame:
    """What a question is about is looked up: its fact in the index, its entities among the known ones."""
    q = questions(spark, d)
    facts = FI.current(table(spark, d, "knowledge_facts")).select(F.col("memory_id").alias("query_id"), F.col("entity_key").alias("q_entity"), F.col("attribute_key").alias("q_attribute"))
    named = G.entities_in(q, "query_id", "query", table(spark, d, "entities"), table(spark, d, "entity_aliases")).join(table(spark, d, "entities").select(F.col("id").alias("entity_id"), "normalized_name"), "entity_id")
    return _selected(spark, d, q, facts, named.select(F.col("id").alias("query_id"), F.col("normalized_name").alias("name")))


def _asked_context(spark: SparkSession, d: str) -> DataFrame:
    """What a question is about is read from its text alone."""
    q = questions(spark, d)
    read = q.select("query_id", extraction.asked(F.col("query")).alias("a"))
    facts = read.select("query_id", F.col("a.entity").alias("q_entity"), F.col("a.attribute").alias("q_attribute"))
    return _selected(spark, d, q, facts, read.select("query_id", F.explode("a.names").alias("name")))


def query_intents(spark: SparkSession, d: str) -> DataFrame:
    """Entity, attribute, temporal intent and entity names that each question asks for."""
    q = questions(spark, d).select("query_id", "query", extraction.asked(F.col("query")).alias("a"))
    return q.select("query_id", F.col("a.entity").alias("entity"), F.col("a.attribute").alias("attribute"), X.temporal_intent(F.col("query")).alias("intent"), F.array_join("a.names", "|").alias("names"))


def context_selection(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).select("query_id", "memory_id", "final_rank", F.round("final_score", 6).alias("final_score"), "effective")


def context_package(spark: SparkSession, d: str) -> DataFrame:
    return C.assembled(_context(spark, d), questions(spark, d)).select("query_id", "prompt")


def agent_answers(spark: SparkSession, d: str) -> DataFrame:
    """Prompt, response and the memories used, for questions read from their text."""
    a = C.answered(C.assembled(_asked_context(spark, d), questions(spark, d)))
    return a.select("query_id", "prompt", "response", F.array_join("memory_ids", ",").alias("memory_ids"))


def domain_winners(spark: SparkSession, d: str) -> DataFrame:
    """The current answer of each fact domain over all memories: state, then newest, then greatest id."""
    index = FI.current(table(spark, d, "knowledge_facts"))
    m = table(spark, d, "memories").select(F.col("id").alias("memory_id"), "created_at")
    h = L.historical_ids(table(spark, d, "memory_relationships")).withColumn("past", F.lit(True))
    j = index.join(m, "memory_id").join(h, "memory_id", "left").withColumn("effective", F.when(F.col("past"), "HISTORICAL").otherwise(F.col("temporal_state")))
    best = F.max_by(F.struct("memory_id", "effective"), F.struct(C.priority(F.col("effective"), F.lit("CURRENT")).alias("p"), "created_at", "memory_id"))
    value = F.when(F.coalesce("single_valued", F.lit(False)), "").otherwise(F.col("value_key"))
    # a partial aggregate instead of a window: a hot domain sends one row from each task
    g = j.groupBy("tenant", "entity_key", "attribute_key", value.alias("value")).agg(best.alias("b"))
    return g.select("tenant", "entity_key", "attribute_key", "value", F.col("b.memory_id").alias("memory_id"), F.col("b.effective").alias("effective"))


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Contents of each conversation in order of arrival that fit 1,200 characters."""
    e = table(spark, d, "memory_evidence").where("raw_text IS NOT NULL AND conversation_id IS NOT NULL").select("conversation_id", "observed_at", "id", F.col("raw_text").alias("content")).distinct()
    w = Window.partitionBy("conversation_id").orderBy("observed_at", "id")
    # no text is shorter than one character: a longer prefix cannot fit, so ranks are cut before the sort
    e = e.where(F.length("content") > 0).withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= C.BUDGET)
    return C.within_budget(e, group="conversation_id").select("conversation_id", "id", "used")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the hybrid ranking: relevant are the memories about an entity of the question."""
    ranked = _candidates(spark, d).select("query_id", F.col("memory_id").alias("item"), "rank")
    g = graph_search(spark, d).select("query_id", F.col("memory_id").alias("item"))
    return E.averages(E.ranking_metrics(ranked, g, 3))


def duplicate_statements(spark: SparkSession, d: str) -> DataFrame:
    """Each question as a statement: a duplicate of its nearest other memory, or new."""
    x = R.duplicate_or_new(questions(spark, d), table(spark, d, "memories"))
    return x.withColumn("importance", F.round("importance", 6))


def fact_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return FI.contradicted(FI.current(table(spark, d, "knowledge_facts")))


def pair_quality(spark: SparkSession, d: str) -> DataFrame:
    """Supersession links held against the contradictions between current claims."""
    links = L.distinct_links(table(spark, d, "memory_relationships")).where("relationship_type = 'superseded_by'").select(F.col("source_memory_id").alias("a"), F.col("target_memory_id").alias("b"))
    told = fact_contradictions(spark, d).select(F.col("contradicted_id").alias("a"), F.col("memory_id").alias("b"))
    return E.pair_precision_recall(links, told)


QUERIES = {f.__name__: f for f in (semantic_search, lexical_search, graph_search, hybrid_retrieval, query_intents, context_selection, context_package, agent_answers, domain_winners, budget_prefix, retrieval_metrics, duplicate_statements, fact_contradictions, pair_quality)}

_Q = "q AS (SELECT id AS query_id, tenant, content AS query, embedding, false AS past FROM memories WHERE id % 20 = 0 AND content IS NOT NULL)"
_SEM = """vm AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM memories WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pr AS (SELECT q.query_id, m.id AS memory_id, 1 - list_cosine_similarity(x.v, m.v) AS distance FROM q JOIN vm x ON x.id = q.query_id JOIN vm m ON m.tenant = q.tenant AND (m.state <> 'archived' OR q.past)
 UNION ALL SELECT q.query_id, m.id, NULL FROM q JOIN vm x ON x.id = q.query_id JOIN memories m ON m.tenant = q.tenant AND (m.state <> 'archived' OR q.past) WHERE m.id NOT IN (SELECT id FROM vm)),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, memory_id) AS rank FROM pr) WHERE rank <= 20)"""
_TOK = f"tk AS (SELECT id, tenant, state, {TQ.sql_tokens('content')} AS t FROM memories WHERE content IS NOT NULL), qt AS (SELECT q.*, {TQ.sql_tokens('query')} AS t FROM q), qq AS (SELECT *, {TQ.sql_terms('t')} AS terms FROM qt)"
_LEX = "lp AS (SELECT query_id, memory_id FROM (SELECT query_id, tk.id AS memory_id, row_number() OVER (PARTITION BY query_id ORDER BY tk.id) AS r FROM qq JOIN tk ON tk.tenant = qq.tenant AND (tk.state <> 'archived' OR qq.past) AND list_has_any(tk.t, qq.terms)) WHERE r <= 30)"
_MENTIONS = SQ.SQL["graph_mentions"].removeprefix("WITH RECURSIVE ").rpartition("SELECT DISTINCT id, unnest(e)")[0].rstrip() + ", gm AS (SELECT DISTINCT id, unnest(e) AS entity_id FROM (SELECT id, e, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS r FROM f) WHERE r = 1)"
_GRA = "gp AS (SELECT DISTINCT q.query_id, m.id AS memory_id FROM q JOIN gm ON gm.id = q.query_id JOIN memory_entities e ON e.entity_id = gm.entity_id JOIN memories m ON m.id = e.memory_id AND m.tenant = q.tenant)"
_SCORE = f"""un AS (SELECT query_id, memory_id, min(distance) AS distance, max(lx) AS lx, max(gx) AS gx FROM (SELECT query_id, memory_id, distance, 0 AS lx, 0 AS gx FROM sp UNION ALL SELECT query_id, memory_id, NULL, 1, 0 FROM lp UNION ALL SELECT g.query_id, g.memory_id, NULL, 0, 1 FROM gp g JOIN memories m ON m.id = g.memory_id JOIN q ON q.query_id = g.query_id WHERE m.state <> 'archived' OR q.past) GROUP BY 1, 2),
s1 AS (SELECT un.*, m.content, m.category, m.importance, m.access_count, m.state, m.created_at, m.last_accessed, m.is_contradicted, qq.query, qq.t AS qt, qq.terms, tk.t AS mt,
 len(list_filter(qq.terms, lambda z: list_contains(tk.t, z))) AS matched FROM un JOIN memories m ON m.id = memory_id JOIN qq USING (query_id) LEFT JOIN tk ON tk.id = m.id),
s2 AS (SELECT *, CASE WHEN len(mt) = 0 OR len(qt) = 0 OR mt IS NULL THEN 0.0 WHEN contains('|' || array_to_string(mt, '|') || '|', '|' || array_to_string(qt, '|') || '|') THEN 1.0 WHEN len(terms) = 0 THEN 0.0
 WHEN len(terms) > 1 AND matched = 1 THEN CAST(matched AS DOUBLE) / len(terms) * CAST(0.15 AS DOUBLE) ELSE CAST(matched AS DOUBLE) / len(terms) END AS lexical FROM s1),
s3 AS (SELECT *, greatest(0.0, CASE WHEN distance IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - distance)) END * 0.40::DOUBLE + lexical * 0.20::DOUBLE + gx * 0.15::DOUBLE + CASE WHEN coalesce(importance, 0) = 0 THEN 0.5 ELSE importance END * 0.10::DOUBLE
 + {TQ.sql_recency('last_accessed', 'created_at')} * 0.06::DOUBLE + {TQ.SQL_ACCESS} * 0.04::DOUBLE + coalesce((category = {TQ.sql_query_category('query')})::INTEGER, 0) * 0.05::DOUBLE - CASE WHEN coalesce(is_contradicted, false) THEN 0.80::DOUBLE ELSE 0 END) AS score FROM s2),
hr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, distance NULLS LAST, memory_id) AS rank FROM s3) WHERE rank <= 10)"""
_HYBRID = f"WITH RECURSIVE {_Q}, {_SEM}, {_TOK}, {_LEX}, {_MENTIONS}, {_GRA}, {_SCORE}"
# questions about the past see archived memories
_QP = _Q.replace("false AS past", f"{TQ.sql_temporal_intent('content')} = 'HISTORICAL' AS past")
_WORDS = " + ".join(f"CASE WHEN {TQ.sql_cue('query', (w,))} AND {TQ.sql_cue('content', (w,))} THEN 0.15::DOUBLE ELSE 0 END" for w in X.TEMPORAL_WORDS)
_CONTEXT = f"""WITH RECURSIVE {_QP}, {_SEM}, {_TOK}, {_LEX}, {_MENTIONS}, {_GRA}, {_SCORE}, {SQ._HIST}, {SQ._CURRENT},
eb AS (SELECT r.query_id, r.memory_id, count(*) FILTER (WHERE regexp_matches(r.content, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(e.normalized_name) || '($|[^\\p{{L}}\\p{{N}}_])')) * 0.10::DOUBLE AS bonus
 FROM hr r JOIN (SELECT DISTINCT g.id, n.normalized_name FROM gm g JOIN entities n ON n.id = g.entity_id WHERE trim(n.normalized_name) <> '') e ON e.id = r.query_id GROUP BY 1, 2),
ev AS (SELECT r.*, f.entity_key, f.attribute_key, f.value_key, f.single_valued, f.temporal_state, m.contradicted_by_id, CASE WHEN r.memory_id IN (SELECT memory_id FROM hist) AND f.entity_key IS NOT NULL THEN 'HISTORICAL' ELSE f.temporal_state END AS effective, {TQ.sql_temporal_intent('r.query')} AS intent,
 score + coalesce(eb.bonus, 0) + {_WORDS} + CASE WHEN qf.attribute_key IS NULL THEN 0 WHEN f.attribute_key IS NOT NULL THEN CASE WHEN lower(qf.entity_key) = f.entity_key AND lower(qf.attribute_key) = f.attribute_key THEN 0.35::DOUBLE WHEN contains(f.attribute_key, lower(qf.attribute_key)) THEN 0.20::DOUBLE ELSE 0 END WHEN contains(lower(r.content), lower(qf.attribute_key)) THEN 0.15::DOUBLE ELSE 0 END AS evidence
 FROM hr r JOIN (SELECT id, contradicted_by_id FROM memories) m ON m.id = r.memory_id LEFT JOIN eb ON eb.query_id = r.query_id AND eb.memory_id = r.memory_id LEFT JOIN cur f ON f.memory_id = r.memory_id LEFT JOIN cur qf ON qf.memory_id = r.query_id),
k1 AS (SELECT *, CASE WHEN coalesce(single_valued, false) THEN '' ELSE value_key END AS dv, CASE intent WHEN 'FUTURE' THEN CASE effective WHEN 'FUTURE' THEN 3 WHEN 'CURRENT' THEN 2 WHEN 'UNKNOWN' THEN 1 WHEN 'HISTORICAL' THEN 0 ELSE 1 END ELSE CASE effective WHEN 'CURRENT' THEN 3 WHEN 'UNKNOWN' THEN 2 WHEN 'HISTORICAL' THEN 1 WHEN 'FUTURE' THEN 0 ELSE 1 END END AS p, bool_or(state = 'active') OVER (PARTITION BY query_id) AS active FROM ev),
k2 AS (SELECT * FROM k1 WHERE (intent = 'HISTORICAL' OR NOT (coalesce(is_contradicted, false) OR contradicted_by_id IS NOT NULL)) AND NOT (state = 'archived' AND NOT coalesce(is_contradicted, false) AND coalesce(active, false))),
k3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity_key, attribute_key, dv ORDER BY p DESC, created_at DESC NULLS LAST, memory_id DESC) AS place, min(rank) OVER (PARTITION BY query_id, entity_key, attribute_key, dv) AS seen FROM k2),
k4 AS (SELECT *, CASE WHEN intent = 'HISTORICAL' OR entity_key IS NULL THEN rank ELSE 1000000 + seen END AS seat, evidence + CASE WHEN effective = intent AND NOT coalesce(temporal_state = 'FUTURE' AND effective = 'HISTORICAL', false) THEN 0.25::DOUBLE ELSE 0 END AS final_score FROM k3 WHERE intent = 'HISTORICAL' OR entity_key IS NULL OR place = 1),
k5 AS (SELECT *, lower(trim(content)) AS txt, {TQ.sql_token_set('lower(trim(content))')} AS ws, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 12) DESC, seat) AS INTEGER) AS final_rank FROM k4),
nl AS (SELECT x.query_id, x.final_rank, list(y.final_rank) AS near FROM k5 x JOIN k5 y ON y.query_id = x.query_id AND y.final_rank < x.final_rank AND (x.txt = y.txt OR (NOT (coalesce(x.entity_key, '') <> '' AND coalesce(x.entity_key = y.entity_key AND x.attribute_key = y.attribute_key AND x.value_key <> y.value_key, false))
 AND len(x.ws) > 0 AND len(y.ws) > 0 AND len(list_intersect(x.ws, y.ws))::DOUBLE / len(list_distinct(list_concat(x.ws, y.ws))) >= 0.20)) GROUP BY 1, 2),
dv AS (SELECT query_id, 1 AS k, [1] AS taken FROM k5 WHERE final_rank = 1 UNION ALL SELECT d.query_id, d.k + 1, CASE WHEN len(d.taken) >= 10 OR coalesce(list_has_any(nl.near, d.taken), false) THEN d.taken ELSE list_append(d.taken, d.k + 1) END FROM dv d JOIN k5 x ON x.query_id = d.query_id AND x.final_rank = d.k + 1 LEFT JOIN nl ON nl.query_id = x.query_id AND nl.final_rank = x.final_rank),
tk2 AS (SELECT query_id, unnest(taken) AS final_rank FROM (SELECT query_id, arg_max(taken, k) AS taken FROM dv GROUP BY 1)),
sel AS (SELECT * FROM (SELECT k5.*, sum(length(content)) OVER (PARTITION BY query_id ORDER BY final_rank ROWS UNBOUNDED PRECEDING) AS used FROM k5 JOIN tk2 USING (query_id, final_rank)) WHERE used <= 1200)"""
_BUCKET = lambda title, cond: f"CASE WHEN count(*) FILTER (WHERE {cond}) > 0 THEN chr(10) || chr(10) || '[{title}]' || chr(10) || '- ' || string_agg(content, chr(10) || '- ' ORDER BY final_rank) FILTER (WHERE {cond}) ELSE '' END"
_PARTS = " || ".join(_BUCKET(t, f"category = '{c}'" if c else "coalesce(category, '') NOT IN ('profile', 'preference', 'habit', 'event') AND content IS NOT NULL") for _, c, t in C.BUCKETS)
_TEXT = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_PRI = "CASE effective WHEN 'CURRENT' THEN 3 WHEN 'UNKNOWN' THEN 2 WHEN 'HISTORICAL' THEN 1 WHEN 'FUTURE' THEN 0 ELSE 1 END"

SQL = {
    "semantic_search": f"WITH {_Q}, {_SEM} SELECT query_id, memory_id, round(distance, 6) AS distance, rank FROM sp",
    "lexical_search": f"WITH {_Q}, {_TOK}, {_LEX} SELECT query_id, memory_id FROM lp",
    "graph_search": f"WITH RECURSIVE {_Q}, {_MENTIONS}, {_GRA} SELECT query_id, memory_id FROM gp",
    "hybrid_retrieval": _HYBRID + " SELECT query_id, memory_id, rank, round(score, 6) AS score, round(lexical, 6) AS lexical, concat_ws(',', CASE WHEN distance IS NOT NULL THEN 'semantic_match' END, CASE WHEN lx = 1 THEN 'lexical_match' END, CASE WHEN gx = 1 THEN 'graph_entity_match' END) AS reasons FROM hr",
    "context_selection": _CONTEXT + " SELECT query_id, memory_id, final_rank, round(final_score, 6) AS final_score, effective FROM sel",
    "context_package": _CONTEXT + f", g AS (SELECT q.query_id, q.query, {_PARTS} AS parts FROM q LEFT JOIN sel ON sel.query_id = q.query_id GROUP BY 1, 2) SELECT query_id, {_TEXT(C.PROMPT_HEAD)} || query || {_TEXT(C.PROMPT_MEMORIES)} || CASE WHEN parts = '' THEN {_TEXT(C.PROMPT_NONE)} ELSE parts END AS prompt FROM g",
    "domain_winners": f"""WITH {SQ._HIST}, {SQ._CURRENT}, e AS (SELECT cur.*, m.created_at, CASE WHEN cur.memory_id IN (SELECT memory_id FROM hist) THEN 'HISTORICAL' ELSE temporal_state END AS effective FROM cur JOIN memories m ON m.id = cur.memory_id),
w AS (SELECT *, CASE WHEN coalesce(single_valued, false) THEN '' ELSE value_key END AS value FROM e)
SELECT tenant, entity_key, attribute_key, value, memory_id, effective FROM (SELECT *, row_number() OVER (PARTITION BY tenant, entity_key, attribute_key, value ORDER BY {_PRI} DESC, created_at DESC NULLS LAST, memory_id DESC) AS r FROM w) WHERE r = 1""",
    "budget_prefix": """WITH e AS (SELECT DISTINCT conversation_id, observed_at, id, raw_text FROM memory_evidence WHERE raw_text IS NOT NULL AND conversation_id IS NOT NULL AND length(raw_text) > 0),
r AS (SELECT conversation_id, id, CAST(sum(length(raw_text)) OVER (PARTITION BY conversation_id ORDER BY observed_at NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM e) SELECT * FROM r WHERE used <= 1200""",
    "retrieval_metrics": _HYBRID
    + """, rel AS (SELECT query_id, count(*) AS n FROM gp GROUP BY 1), hh AS (SELECT r.query_id, r.rank, (g.memory_id IS NOT NULL)::INTEGER AS hit FROM hr r LEFT JOIN gp g ON g.query_id = r.query_id AND g.memory_id = r.memory_id),
pp AS (SELECT h.query_id, coalesce(max(n), 0) AS n, count(*) FILTER (WHERE rank <= 3) AS shown, sum(hit) FILTER (WHERE rank <= 3) AS hits, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(hit / log2(rank + 1)) FILTER (WHERE rank <= 3) AS dcg FROM hh h LEFT JOIN rel ON rel.query_id = h.query_id GROUP BY 1),
i AS (SELECT *, (SELECT sum(1 / log2(k + 1)) FROM range(1, least(3, n) + 1) x(k)) AS ideal FROM pp)
SELECT count(*) AS queries, round(avg(hits / shown), 6) AS precision, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE hits / n END), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE coalesce(dcg / ideal, 0) END), 6) AS ndcg FROM i""",
    "duplicate_statements": f"""WITH {_Q}, {_SEM}, b AS (SELECT query_id, arg_min(memory_id, (distance, memory_id)) AS memory_id, min(distance) AS distance FROM pr WHERE query_id <> memory_id AND distance IS NOT NULL GROUP BY 1),
x AS (SELECT b.query_id, b.memory_id, round(least(1.0, coalesce(importance, 0.5) + 0.05::DOUBLE), 6) AS importance, CAST(coalesce(access_count, 0) + 1 AS INTEGER) AS access_count FROM b JOIN memories m ON m.id = b.memory_id WHERE round(1 - distance, 12) >= 0.90::DOUBLE)
SELECT q.query_id, CASE WHEN x.memory_id IS NULL THEN 'new' ELSE 'duplicate' END AS kind, x.memory_id, x.importance, x.access_count FROM q LEFT JOIN x ON x.query_id = q.query_id""",
    "fact_contradictions": f"""WITH {SQ._CURRENT}, c AS (SELECT * FROM cur WHERE single_valued AND NOT is_placeholder AND NOT is_negated AND temporal_state = 'CURRENT' AND value_key IS NOT NULL)
SELECT a.memory_id, max(b.memory_id) AS contradicted_id FROM c a JOIN c b ON b.tenant IS NOT DISTINCT FROM a.tenant AND b.entity_key IS NOT DISTINCT FROM a.entity_key AND b.attribute_key IS NOT DISTINCT FROM a.attribute_key AND b.memory_id < a.memory_id AND b.value_key <> a.value_key GROUP BY 1""",
    "pair_quality": f"""WITH {SQ._LINKS}, {SQ._CURRENT}, c AS (SELECT * FROM cur WHERE single_valued AND NOT is_placeholder AND NOT is_negated AND temporal_state = 'CURRENT' AND value_key IS NOT NULL),
x AS (SELECT DISTINCT source_memory_id AS a, target_memory_id AS b FROM l WHERE relationship_type = 'superseded_by'),
y AS (SELECT max(o.memory_id) AS a, n.memory_id AS b FROM c n JOIN c o ON o.tenant IS NOT DISTINCT FROM n.tenant AND o.entity_key IS NOT DISTINCT FROM n.entity_key AND o.attribute_key IS NOT DISTINCT FROM n.attribute_key AND o.memory_id < n.memory_id AND o.value_key <> n.value_key GROUP BY n.memory_id),
h AS (SELECT count(*) AS hits FROM x JOIN y USING (a, b))
SELECT hits, CASE WHEN (SELECT count(*) FROM x) = 0 THEN 1.0 ELSE round(hits::DOUBLE / (SELECT count(*) FROM x), 6) END AS precision, CASE WHEN (SELECT count(*) FROM y) = 0 THEN 1.0 ELSE round(hits::DOUBLE / (SELECT count(*) FROM y), 6) END AS recall FROM h""",
}
