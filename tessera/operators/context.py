"""From ranked candidates to a context: evidence, conflicts, diversity, budget, assembly.

Facts and temporal states come from the fact index, computed once as columns. Candidates of a query are
at most the retrieval limit, so the folds below run over short arrays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.scale import materialize

ALIGNED = 0.25
OVERLAP = 0.20
BUDGET, LIMIT = 1200, 10
# Which temporal state of a fact answers a question better.
CURRENT_ORDER = {"CURRENT": 3, "UNKNOWN": 2, "HISTORICAL": 1, "FUTURE": 0}
FUTURE_ORDER = {"FUTURE": 3, "CURRENT": 2, "UNKNOWN": 1, "HISTORICAL": 0}
FACT = ["entity_key", "attribute_key", "value_key", "single_valued", "temporal_state"]


def with_facts(candidates: DataFrame, index: DataFrame, historical: DataFrame) -> DataFrame:
    """Adds the memory's fact (null if it has none) and its effective temporal state.

    A memory with a historical link is HISTORICAL whatever its text says.
    """
    f = index.select("memory_id", *FACT)
    h = historical.select("memory_id", F.lit(True).alias("superseded"))
    j = candidates.join(f, "memory_id", "left").join(h, "memory_id", "left")
    return j.withColumn("effective", F.when(F.coalesce("superseded", F.lit(False)) & F.col("entity_key").isNotNull(), "HISTORICAL").otherwise(F.col("temporal_state")))


def entity_bonus(candidates: DataFrame, query_entities: DataFrame) -> DataFrame:
    """(query_id, memory_id, bonus): 0.10 for each of the query's entity names that the content has whole.

    ``query_entities`` has query_id and name.
    """
    j = candidates.select("query_id", "memory_id", "content").join(query_entities.where(F.trim("name") != "").distinct(), "query_id")
    whole = F.expr(r"rlike(content, concat('(?i)\\b\\Q', name, '\\E\\b'))")
    return j.groupBy("query_id", "memory_id").agg((F.count_if(whole) * 0.10).alias("bonus"))


def evidence(candidates: DataFrame, query_facts: DataFrame, query_entities: DataFrame) -> DataFrame:
    """Adds entity, attribute and temporal bonuses and the evidence score.

    ``query_facts`` has query_id, q_entity and q_attribute (null where the query states nothing).
    """
    a, qa = F.col("attribute_key"), F.lower("q_attribute")
    fact = F.when(qa.isNull(), 0.0).when(a.isNotNull(), F.when((F.lower("q_entity") == F.col("entity_key")) & (qa == a), 0.35).when(a.contains(qa), 0.20).otherwise(0.0)).when(F.lower("content").contains(qa), 0.15).otherwise(0.0)
    j = candidates.join(query_facts, "query_id", "left").join(entity_bonus(candidates, query_entities), ["query_id", "memory_id"], "left")
    j = j.withColumn("entity_bonus", F.coalesce("bonus", F.lit(0.0))).withColumn("fact_bonus", F.coalesce(fact, F.lit(0.0))).withColumn("temporal_bonus", X.temporal_match(F.col("query"), F.col("content")))
    return j.drop("bonus", "q_entity", "q_attribute").withColumn("evidence_score", F.col("score") + F.col("entity_bonus") + F.col("fact_bonus") + F.col("temporal_bonus"))


def priority(state: Column, intent: Column) -> Column:
    """How well a temporal state answers a query of the intent; higher wins the domain.

    Other states and none count 1. Of the queries only those about the future prefer plans.
    """
    rank = lambda order: F.coalesce(*[F.when(state == v, n) for v, n in order.items()], F.lit(1))
    return F.when(F.coalesce(intent == "FUTURE", F.lit(False)), rank(FUTURE_ORDER)).otherwise(rank(CURRENT_ORDER))


def resolved(candidates: DataFrame) -> DataFrame:
    """Candidates after conflicts: no contradicted ones, archived ones only if nothing is active, one
    winner for each fact domain.

    A HISTORICAL query keeps contradicted rows and every member of a domain. Rows without fact stay.
    Adds ``seat``: rows without fact before the winners, winners in the order in which their domains first
    appear; it decides between equal scores.
    """
    q = Window.partitionBy("query_id")
    c = candidates.withColumn("intent", X.temporal_intent(F.col("query")))
    past = F.col("intent") == "HISTORICAL"
    contradicted = F.coalesce("is_contradicted", F.lit(False))
    c = c.withColumn("any_active", F.max(F.col("state") == "active").over(q)).where(past | ~(contradicted | F.col("contradicted_by_id").isNotNull()))
    c = c.where(~((F.col("state") == "archived") & ~contradicted & F.col("any_active")))
    value = F.when(F.coalesce("single_valued", F.lit(False)), "").otherwise(F.col("value_key"))
    domain = Window.partitionBy("query_id", "entity_key", "attribute_key", value)
    w = domain.orderBy(F.desc(priority(F.col("effective"), F.col("intent"))), F.desc_nulls_last("created_at"), F.desc("memory_id"))
    loose = past | F.col("entity_key").isNull()
    c = c.withColumn("place", F.row_number().over(w)).withColumn("seat", F.when(loose, F.col("rank")).otherwise(1_000_000 + F.min("rank").over(domain)))
    return c.where(past | F.col("entity_key").isNull() | (F.col("place") == 1)).drop("place", "any_active")


def aligned(candidates: DataFrame) -> DataFrame:
    """0.25 more where the effective state is what the query asks for, except for fulfilled plans."""
    plan_done = (F.col("temporal_state") == "FUTURE") & (F.col("effective") == "HISTORICAL")
    hit = ~F.coalesce(plan_done, F.lit(False)) & F.coalesce(F.col("effective") == F.col("intent"), F.lit(False))
    return candidates.withColumn("final_score", F.col("evidence_score") + F.when(hit, ALIGNED).otherwise(0.0))


def ranked(candidates: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("final_score", 12)), "seat")
    return candidates.withColumn("final_rank", F.row_number().over(w))


def diversified(candidates: DataFrame, limit: int = LIMIT, overlap: float = OVERLAP) -> DataFrame:
    """The first ``limit`` by final_rank that neither repeat nor nearly repeat one taken before.

    Facts of one domain with different values are never near-duplicates. A fold over each query's short
    ranked array.
    """
    item = F.struct("final_rank", "memory_id", F.lower(F.trim("content")).alias("text"), X.token_set(F.lower(F.trim("content"))).alias("words"), F.coalesce("entity_key", F.lit("")).alias("e"), F.coalesce("attribute_key", F.lit("")).alias("a"), F.coalesce("value_key", F.lit("")).alias("v"))
    per = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("c"))
    kind = dict(per.dtypes)["c"]

    def near(p: Column, x: Column) -> Column:
        other_value = (p["e"] != "") & (p["e"] == x["e"]) & (p["a"] == x["a"]) & (p["v"] != x["v"])
        return (p["text"] == x["text"]) | (~other_value & (X.jaccard(p["words"], x["words"]) >= overlap))

    fold = F.aggregate("c", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) < limit) & ~F.exists(acc, lambda p: near(p, x)), F.concat(acc, F.array(x))).otherwise(acc))
    kept = per.select("query_id", F.explode(F.transform(fold, lambda x: x["memory_id"])).alias("memory_id"))
    return candidates.join(kept, ["query_id", "memory_id"])


def within_budget(candidates: DataFrame, budget: int = BUDGET, group: str = "query_id", order: str = "final_rank") -> DataFrame:
    """The longest prefix in ranked order whose contents fit the budget of characters."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return candidates.withColumn("used", F.sum(F.length("content")).over(w)).where(F.col("used") <= budget)


# The buckets of a package with their category and title in the prompt, and the prompt's parts.
BUCKETS = (("profile", "profile", "User Profile"), ("preferences", "preference", "Preferences"), ("habits", "habit", "Habits & Routines"), ("events", "event", "Past Events"), ("other", None, "General Facts"))
PROMPT_HEAD = "System: You are an intelligent AI assistant with a long-term memory.\nUse the relevant long-term memory context below to respond accurately to the user query.\n\nUser Query:\n"
PROMPT_MEMORIES = "\n\nRetrieved Long-Term Memories:"
PROMPT_NONE = "\n- (No relevant prior memories found)"
SIGNALS = ("semantic", "lexical", "graph", "importance", "recency", "access", "category")


def selection_limit(limit: int | None, setting: int = LIMIT) -> int:
    """The number of memories to select: never more than the setting, which None and 0 stand for."""
    return min(limit, setting) if limit else setting


def assembled(candidates: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, profile, preferences, habits, events, other, evidence, prompt) of the selected candidates.

    Contents stand by category and in order of rank; evidence tells of each what it is, how it scored and
    why (signals that were not measured are left out). With ``queries`` (query_id, query) those without any
    memory have a package too, with empty buckets.
    """
    category = F.coalesce("category", F.lit(""))
    named = [c for _, c, _ in BUCKETS if c]
    pick = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("final_rank", "content")))), lambda r: r["content"])
    signals = F.map_filter(F.create_map(*[x for n in SIGNALS for x in (F.lit(n), F.col(f"{n}_score").cast("double"))]), lambda _, v: v.isNotNull())
    told = F.struct("final_rank", "memory_id", "content", "category", F.col("entity_key").alias("entity"), F.col("attribute_key").alias("attribute"), F.col("value_key").alias("value"), F.col("effective").alias("temporal_state"), F.col("state").alias("lifecycle_state"), "confidence", F.col("final_score").alias("score"), F.split("reasons", ",").alias("reasons"), signals.alias("signals"))
    # maps do not sort: the rank orders a list of positions, and each row keeps its own struct
    g = candidates.groupBy("query_id").agg(*[pick(category == c if c else ~category.isin(*named)).alias(k) for k, c, _ in BUCKETS], F.map_from_entries(F.collect_list(F.struct("final_rank", told))).alias("by"), F.first("query").alias("query"))
    g = g.withColumn("evidence", F.transform(F.array_sort(F.map_keys("by")), lambda r: F.element_at("by", r))).drop("by")
    if queries is not None:
        g = queries.select("query_id", F.col("query").alias("asked")).join(g, "query_id", "left").withColumn("query", F.col("asked")).drop("asked")
        g = g.withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k, _, _ in BUCKETS}).withColumn("evidence", F.coalesce("evidence", F.array().cast(g.schema["evidence"].dataType)))
    part = lambda k, title: F.when(F.size(k) > 0, F.concat(F.lit(f"\n\n[{title}]\n- "), F.array_join(k, "\n- "))).otherwise("")
    none = F.when(sum(F.size(k) for k, _, _ in BUCKETS) == 0, PROMPT_NONE).otherwise("")
    return g.withColumn("prompt", F.concat(F.lit(PROMPT_HEAD), F.coalesce("query", F.lit("")), F.lit(PROMPT_MEMORIES), *[part(k, t) for k, _, t in BUCKETS], none))


def answered(packages: DataFrame) -> DataFrame:
    """(query_id, query, prompt, response, memory_ids): answers from packages with ``query``; the memories used in rank order."""
    ids = F.transform("evidence", lambda e: e["memory_id"])
    said = F.array_join(F.transform("evidence", lambda e: e["content"]), "; ")
    some = F.concat(F.lit("Based on your stored memories ("), said, F.lit("), here is what I know regarding: '"), F.col("query"), F.lit("'."))
    none = F.concat(F.lit("I don't have any specific stored memories yet for '"), F.col("query"), F.lit("'."))
    return packages.select("query_id", "query", "prompt", F.when(F.size("evidence") > 0, some).otherwise(none).alias("response"), ids.alias("memory_ids"))


def used_memories(answers: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, rank, memory_id, content): the memories behind each answer in its order, lost ones left out."""
    u = answers.select("query_id", F.posexplode("memory_ids").alias("rank", "memory_id"))
    return u.join(memories.select(F.col("id").alias("memory_id"), "content"), "memory_id").select("query_id", (F.col("rank") + 1).alias("rank"), "memory_id", "content")


def build(candidates: DataFrame, index: DataFrame, historical: DataFrame, query_facts: DataFrame, query_entities: DataFrame, limit: int | None = None, budget: int = BUDGET) -> DataFrame:
    """The selected memories of each query, ranked, from retrieval candidates (written once, read twice)."""
    c = evidence(with_facts(materialize(candidates), index, historical), query_facts, query_entities)
    return within_budget(diversified(ranked(aligned(resolved(c))), selection_limit(limit)), budget)
