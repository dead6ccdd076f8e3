"""Queries of the scalar functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as X
from tessera.sources.tables import table

AS_OF = "2025-06-01 00:00:00"
#: Columns of words travel as one string, so that engines agree on how to compare them.
SEP = " "


def _memories(spark: SparkSession, d: str, *cols) -> DataFrame:
    return table(spark, d, "memories").select("id", *cols)


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _memories(spark, d, F.array_join(X.tokens(c), SEP).alias("tokens"), F.array_join(X.query_terms(c), SEP).alias("terms"))


def text_cues(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    cues = {"past": X.PAST_CUES, "future": X.FUTURE_CUES, "transition": X.TRANSITION_CUES, "negation": X.NEGATION_CUES}
    return _memories(spark, d, *[X.has_cue(c, v).alias(k) for k, v in cues.items()], X.temporal_intent(c).alias("temporal_intent"))


def text_intents(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _memories(spark, d, X.intent(c).alias("intent"), X.query_category(c).alias("query_category"), F.round(S.category_importance(F.col("category")), 6).alias("importance"), X.category_match(c, F.col("category")).alias("category_match"))


def text_temporal_expressions(spark: SparkSession, d: str) -> DataFrame:
    e = _memories(spark, d, F.posexplode(X.temporal_expressions(F.col("content"))).alias("pos", "e"))
    return e.select("id", "pos", "e.category", "e.value")


def text_token_sets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _memories(spark, d, F.array_join(F.array_sort(X.token_set(c)), SEP).alias("words"), F.size(X.raw_token_set(c)).alias("raw_words"))


def text_entity_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("id", X.entity_name(F.col("display_name")).alias("name"))


def text_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _memories(spark, d, F.sha2("content", 256).alias("sha256"))


def fact_domains(spark: SparkSession, d: str) -> DataFrame:
    single = S.single_valued(F.col("attribute_key"), F.col("fact_type"))
    f = table(spark, d, "knowledge_facts")
    return f.select("memory_id", "updated_at", X.fact_key(F.col("value_text")).alias("value"), single.alias("single"), S.domain_key(F.col("entity_key"), F.col("attribute_key"), F.col("value_text"), single).alias("domain"))


def score_signals(spark: SparkSession, d: str) -> DataFrame:
    six = lambda c: F.round(c, 6)
    return _memories(
        spark,
        d,
        six(S.recency(F.col("last_accessed"), F.col("created_at"), AS_OF)).alias("recency"),
        six(S.access(F.col("access_count"))).alias("access"),
        six(S.importance_signal(F.col("importance"))).alias("importance"),
        six(S.reinforced(F.col("confidence"))).alias("reinforced"),
        six(S.doubted(F.col("confidence"))).alias("doubted"),
        S.lifecycle(F.col("state"), F.col("access_count")).alias("lifecycle"),
        S.decayed(F.col("state"), F.col("importance"), F.col("access_count")).alias("decayed"),
    )


def score_distances(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories")
    ok = (F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0)
    a = m.where(ok).select("id", "contradicted_by_id", "importance", "access_count", F.col("embedding").alias("x"))
    b = m.where(ok).select(F.col("id").alias("contradicted_by_id"), F.col("embedding").alias("y"))
    j = a.join(b, "contradicted_by_id").withColumn("distance", S.cosine_distance(F.col("x"), F.col("y")))
    dist = F.round("distance", 6)
    return j.select("id", "contradicted_by_id", dist.alias("distance"), F.round(S.similarity(F.col("distance")), 6).alias("similarity"), S.distance_class(dist).alias("distance_class"), S.candidate_decision(dist).alias("decision"), F.round(S.simple_score(F.col("distance"), F.col("importance"), F.col("access_count")), 5).alias("score"))


QUERIES = {f.__name__: f for f in (text_tokens, text_cues, text_intents, text_temporal_expressions, text_token_sets, text_entity_names, text_content_hash, fact_domains, score_signals, score_distances)}


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_tokens(x: str) -> str:
    base = "CASE WHEN t LIKE '%''s' THEN left(t, length(t) - 2) ELSE t END"
    folded = "CASE WHEN length(u) > 4 AND u LIKE '%ies' THEN left(u, length(u) - 3) || 'y' WHEN length(u) > 3 AND u LIKE '%s' AND u NOT LIKE '%ss' THEN left(u, length(u) - 1) ELSE u END"
    return f"list_transform(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+(?:''[a-z]+)?'), lambda t: {base}), lambda u: {folded})"


def sql_terms(tokens: str) -> str:
    words = f"list_filter({tokens}, lambda t: length(t) > 1)"
    content = f"list_filter({words}, lambda t: t NOT IN {sql_list(X.STOP_WORDS)})"
    return f"CASE WHEN len({content}) > 0 THEN {content} ELSE {words} END"


def sql_cue(x: str, cues) -> str:
    return f"coalesce(regexp_matches({x}, '{X.cue_pattern(tuple(cues)).replace(chr(39), chr(39) * 2)}'), false)"


def sql_temporal_intent(x: str) -> str:
    return f"CASE WHEN {sql_cue(x, X.HISTORICAL_QUERY_CUES)} THEN 'HISTORICAL' WHEN {sql_cue(x, X.FUTURE_QUERY_CUES)} THEN 'FUTURE' ELSE 'CURRENT' END"


def sql_query_category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_cue(x, v)} THEN '{k}'" for k, v in X.QUERY_CATEGORIES) + " END"


def sql_token_set(x: str) -> str:
    words = f"list_filter(list_transform(regexp_split_to_array(lower(coalesce({x}, '')), '\\s+'), lambda w: regexp_replace(w, '^[.,!?\"'']+|[.,!?\"'']+$', '', 'g')), lambda w: length(w) > 1)"
    content = f"list_filter({words}, lambda w: w NOT IN {sql_list(X.STOP_WORDS)})"
    return f"list_distinct(CASE WHEN len({content}) > 0 THEN {content} ELSE {words} END)"


def sql_recency(last: str, created: str) -> str:
    return f"CASE WHEN coalesce({last}, {created}) IS NULL THEN 0.5 ELSE 1 / (1 + greatest(0.0, (epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(coalesce({last}, {created}))) / 86400000000.0) * 0.1) END"


SQL_ACCESS = "CASE WHEN coalesce(access_count, 0) <= 0 THEN 0.0 ELSE least(1.0, ln(1 + access_count) * CAST(0.3 AS DOUBLE)) END"
_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(content, '')), '{k.replace(chr(39), chr(39) * 2)}')" for k in v) + f" THEN '{n}'" for n, v in X.INTENTS) + " ELSE 'fact' END"
_EXPRESSIONS = ", ".join(f"{{'category': '{c}', 'value': regexp_extract(lower(coalesce(content, '')), '\\b{w}\\b')}}" for c, ws in X.TEMPORAL_EXPRESSIONS for w in ws)
_MATCH = "CASE " + " ".join(f"WHEN category = '{k}' AND {sql_cue('content', (*v, *(c + 's' for c in v)))} THEN CAST(0.15 AS DOUBLE)" for k, v in X.CATEGORY_WORDS.items()) + " ELSE 0.0 END"
_EDGE = "[.,!?;:\"''()\\[\\]{}]+"
_SINGLE = f"coalesce(attribute_key IN {sql_list(S.SINGLE_VALUED)} OR starts_with(lower(trim(attribute_key)), 'favorite_') OR fact_type IN {sql_list(S.SINGLE_VALUED_TYPES)}, false)"

SQL = {
    "text_tokens": f"SELECT id, array_to_string(t, ' ') AS tokens, array_to_string({sql_terms('t')}, ' ') AS terms FROM (SELECT id, {sql_tokens('content')} AS t FROM memories)",
    "text_cues": "SELECT id, " + ", ".join(f"{sql_cue('content', v)} AS {k}" for k, v in (("past", X.PAST_CUES), ("future", X.FUTURE_CUES), ("transition", X.TRANSITION_CUES), ("negation", X.NEGATION_CUES))) + f", {sql_temporal_intent('content')} AS temporal_intent FROM memories",
    "text_intents": f"SELECT id, {_INTENT} AS intent, {sql_query_category('content')} AS query_category, CASE lower(category) WHEN 'profile' THEN 0.95::DOUBLE WHEN 'preference' THEN 0.80::DOUBLE WHEN 'habit' THEN 0.70::DOUBLE WHEN 'event' THEN 0.50::DOUBLE ELSE 0.40::DOUBLE END AS importance, {_MATCH} AS category_match FROM memories",
    "text_temporal_expressions": f"SELECT id, CAST(unnest(range(len(e))) AS INTEGER) AS pos, unnest(e).category AS category, unnest(e).value AS value FROM (SELECT id, list_filter([{_EXPRESSIONS}], lambda x: x.value <> '') AS e FROM memories)",
    "text_token_sets": f"SELECT id, array_to_string(list_sort({sql_token_set('content')}), ' ') AS words, CAST(len(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '\\s+'), lambda w: w <> ''))) AS INTEGER) AS raw_words FROM memories",
    "text_entity_names": f"""WITH w AS (SELECT id, list_filter(list_transform(regexp_split_to_array(lower(regexp_replace(coalesce(display_name, ''), '^\\s+|\\s+$', '', 'g')), '\\s+'), lambda x: regexp_replace(x, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda x: x <> '') AS w FROM entities),
k AS (SELECT id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] NOT IN {sql_list(X.DETERMINERS)})[1] AS first FROM w)
SELECT id, CASE WHEN first IS NULL THEN '' ELSE regexp_replace(array_to_string(w[first:], ' '), '''s$', '') END AS name FROM k""",
    "text_content_hash": "SELECT id, sha256(content) AS sha256 FROM memories",
    "fact_domains": f"SELECT memory_id, updated_at, lower(regexp_replace(value_text, '^\\s+|\\s+$', '', 'g')) AS value, {_SINGLE} AS single, lower(trim(entity_key)) || '|' || lower(trim(attribute_key)) || CASE WHEN {_SINGLE} THEN '' ELSE '|' || lower(trim(value_text)) END AS domain FROM knowledge_facts",
    "score_signals": f"""SELECT id, round({sql_recency('last_accessed', 'created_at')}, 6) AS recency, round({SQL_ACCESS}, 6) AS access,
 round(CASE WHEN coalesce(importance, 0) = 0 THEN 0.5 ELSE importance END, 6) AS importance, round(least(1.0, confidence + 0.10::DOUBLE), 6) AS reinforced,
 round(greatest(0.0, confidence - 0.20::DOUBLE), 6) AS doubted,
 CASE WHEN state = 'archived' THEN state WHEN coalesce(access_count, 0) >= 3 THEN 'active' ELSE 'weak' END AS lifecycle,
 CASE WHEN state = 'active' AND coalesce(importance, 0) < 0.5 AND coalesce(access_count, 0) < 3 THEN 'weak' ELSE state END AS decayed FROM memories""",
    "score_distances": """WITH m AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM memories WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
j AS (SELECT a.id, a.contradicted_by_id, a.importance, a.access_count, 1 - list_cosine_similarity(a.v, b.v) AS d FROM m a JOIN m b ON a.contradicted_by_id = b.id)
SELECT id, contradicted_by_id, round(d, 6) AS distance, round(greatest(0.0, least(1.0, 1 - d)), 6) AS similarity,
 CASE WHEN round(d, 6) <= 0.10 THEN 'duplicate' WHEN round(d, 6) <= 0.30 THEN 'reinforcement' WHEN round(d, 6) <= 0.45 THEN 'related' ELSE 'independent' END AS distance_class,
 CASE WHEN round(d, 6) <= 0.05 THEN 'ignore' WHEN round(d, 6) <= 0.20 THEN 'reinforce' WHEN round(d, 6) <= 0.40 THEN 'related' ELSE 'new' END AS decision,
 round(greatest(0.0, least(1.0, 1 - d)) * 0.50::DOUBLE + CASE WHEN coalesce(importance, 0) = 0 THEN 0.5 ELSE importance END * 0.25::DOUBLE + least(coalesce(access_count, 0) / 10.0::DOUBLE, 1.0) * 0.15::DOUBLE, 5) AS score FROM j""",
}
