"""Hybrid retrieval for a table of queries: vector, word and entity pools, scored and ranked.

All pools are taken within the query's tenant. The vector pool is exact: rows of a tenant are cut into
blocks, each block meets the tenant's queries as one matrix product, and only the best of a block leave
it. The word pool joins an inverted index whose lists are cut to the pool's size before the join, which
loses nothing, as the pool is the first ids of the union.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scoring as S
from tessera.functions import text as X
from tessera.operators import graph

SEMANTIC_POOL, LEXICAL_POOL = 20, 30
#: Rows of a tenant in a block, and queries beside them.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
DIM = 64


#: Whether a row counts for a query: archived ones only for queries about the past.
SEEN = "past OR state <> 'archived'"


def with_past(queries: DataFrame, include_archived: bool = False) -> DataFrame:
    """Queries with the column ``past``: whether archived memories count for them."""
    return queries if "past" in queries.columns else queries.withColumn("past", F.lit(include_archived))


def _scored(pool: int):
    """applyInArrow function over a block: the ``pool`` nearest rows of each query by cosine distance.

    ``old`` marks archived rows, and of the queries those that see them.
    """

    def run(t: pa.Table) -> pa.Table:
        role, ids, old = t.column("role").to_numpy(), t.column("id").to_numpy(), t.column("old").to_numpy()
        v = np.array(t.column("v").combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        q, m = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        out: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(q) if len(m) else 0, 256):
            part = q[lo : lo + 256]
            d = 1 - v[part] @ v[m].T
            d[~old[part][:, None] & old[m][None, :]] = np.inf
            k = min(pool, d.shape[1])
            edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            r, c = np.nonzero((d <= edge + 1e-12) & np.isfinite(d))
            order = np.lexsort((ids[m[c]], d[r, c], r))
            r, c = r[order], c[order]
            first = np.searchsorted(r, np.arange(d.shape[0]))
            keep = np.arange(len(r)) - first[r] < k
            r, c = r[keep], c[keep]
            out.append((ids[part[r]], ids[m[c]], d[r, c]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(cols, names=["query_id", "memory_id", "distance"])

    return run


def usable() -> Column:
    """Whether ``embedding`` has the width, only finite values and not only zeros."""
    return F.coalesce((F.size("embedding") == DIM) & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def semantic_pool(queries: DataFrame, memories: DataFrame, pool: int = SEMANTIC_POOL, include_archived: bool = False) -> DataFrame:
    """(query_id, memory_id, distance, rank): the nearest memories of the query's tenant.

    ``queries`` has query_id, tenant and embedding. Memories without a usable vector come after all
    others by id, without a distance: they fill the pool of a tenant that has too few. A query without
    a usable vector has no pool. Ties go to the lesser id.
    """
    q = with_past(queries, include_archived).where(usable()).where("tenant IS NOT NULL")
    m = memories.select("id", "tenant", "embedding", F.coalesce("state", F.lit("")).alias("state"), usable().alias("ok")).where("tenant IS NOT NULL")
    rows = m.where("ok")
    count = rows.groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    hashed = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    qn = q.groupBy("tenant").agg(F.count(F.lit(1)).alias("qn")).withColumn("qb", F.ceil(F.col("qn") / BLOCK_QUERIES).cast("int"))
    asked = q.join(count, "tenant").join(qn, "tenant").select("tenant", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), hashed(F.col("query_id"), F.col("qb")).alias("part"), F.lit(1).alias("role"), F.col("query_id").alias("id"), F.col("past").alias("old"), F.col("embedding").alias("v"))
    data = rows.join(count, "tenant").join(qn, "tenant").select("tenant", hashed(F.col("id"), blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("part"), F.lit(0).alias("role"), "id", (F.col("state") == "archived").alias("old"), F.col("embedding").alias("v"))
    near = asked.unionByName(data).groupBy("tenant", "block", "part").applyInArrow(_scored(pool), "query_id bigint, memory_id bigint, distance double")
    # small tenants only: rows without vector for the places that are left
    seen = rows.groupBy("tenant").agg(F.count_if(F.col("state") != "archived").alias("live"), F.count(F.lit(1)).alias("every"))
    w = Window.partitionBy("tenant")
    first = F.row_number().over(w.orderBy("id"))
    bare = m.where("NOT ok").join(seen, "tenant", "left").where(f"coalesce(live, 0) < {pool}")
    # of the rows in order of id, the first of all and the first live ones can be in a pool
    bare = bare.withColumn("r", first).withColumn("old", F.col("state") == "archived").withColumn("lr", F.row_number().over(Window.partitionBy("tenant", "old").orderBy("id"))).where((F.col("r") <= pool) | (F.col("lr") <= pool))
    last = q.select("query_id", "tenant", "past").join(bare.select("tenant", F.col("id").alias("memory_id"), "state"), "tenant").where(SEEN)
    found = near.unionByName(last.select("query_id", "memory_id", F.lit(None).cast("double").alias("distance")))
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "memory_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)


def lexical_pool(queries: DataFrame, memories: DataFrame, pool: int = LEXICAL_POOL, include_archived: bool = False) -> DataFrame:
    """(query_id, memory_id): the first ``pool`` memories by id that have any term of the query.

    Only terms that a query of the tenant has are kept of the memories' words, before anything is ranked.
    """
    q = with_past(queries, include_archived)
    terms = q.select("query_id", "tenant", "past", F.explode(F.array_distinct(X.query_terms(F.col("query")))).alias("term"))
    raw = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(X.WORD), F.lit(0)))
    words = memories.select("tenant", F.col("id").alias("memory_id"), F.coalesce("state", F.lit("")).alias("state"), F.explode(raw).alias("raw"))
    # folded behind the explode, where it is compiled; two words of a text may fold to one term, so ids are ranked densely
    words = words.withColumn("term", X.fold(F.col("raw"))).drop("raw")
    words = words.join(terms.select("tenant", "term").distinct(), ["tenant", "term"], "left_semi").withColumn("old", F.col("state") == "archived")
    first = F.dense_rank().over(Window.partitionBy("tenant", "term", "old").orderBy("memory_id"))
    index = words.withColumn("r", first).where(F.col("r") <= pool).drop("r", "old")
    hit = terms.join(index, ["tenant", "term"]).where(SEEN).select("query_id", "memory_id").distinct()
    w = Window.partitionBy("query_id").orderBy("memory_id")
    return hit.withColumn("r", F.row_number().over(w)).where(F.col("r") <= pool).drop("r")


def graph_pool(queries: DataFrame, entities: DataFrame, aliases: DataFrame, memory_entities: DataFrame, memories: DataFrame, include_archived: bool = True) -> DataFrame:
    """(query_id, memory_id): memories of the tenant linked to entities that the query names.

    Links get their memory's tenant before they meet the queries, so a popular entity costs its links in
    the query's own tenant only.
    """
    q = with_past(queries, include_archived)
    found = graph.entities_in(q, "query_id", "query", entities, aliases).withColumnRenamed("id", "query_id").select("query_id", "entity_id")
    asked = q.select("query_id", "tenant", "past").join(found, "query_id")
    links = memory_entities.select("memory_id", "entity_id").distinct().join(asked.select("entity_id").distinct(), "entity_id", "left_semi")
    links = links.join(memories.select(F.col("id").alias("memory_id"), "tenant", F.coalesce("state", F.lit("")).alias("state")), "memory_id")
    return asked.join(links, ["tenant", "entity_id"]).where(SEEN).select("query_id", "memory_id").distinct()


def candidates(queries: DataFrame, memories: DataFrame, entities: DataFrame, aliases: DataFrame, memory_entities: DataFrame, as_of: str, limit: int = 10, include_archived: bool = False) -> DataFrame:
    """The ``limit`` best memories for each query, with every signal, the score, its rank and reasons.

    ``queries`` has query_id, tenant, query and embedding, and may say by ``past`` whether archived
    memories count for it. Blank queries have no rows. Order: score, then distance (missing last), then id.
    """
    q = with_past(queries, include_archived).where(F.length(F.trim("query")) > 0)
    sem = semantic_pool(q, memories).select("query_id", "memory_id", "distance", F.lit(False).alias("lexical"), F.lit(False).alias("graph"))
    none = F.lit(None).cast("double").alias("distance")
    lex = lexical_pool(q, memories).select("query_id", "memory_id", none, F.lit(True).alias("lexical"), F.lit(False).alias("graph"))
    gra = graph_pool(q, entities, aliases, memory_entities, memories).select("query_id", "memory_id", none, F.lit(False).alias("lexical"), F.lit(True).alias("graph"))
    pool = sem.unionByName(lex).unionByName(gra).groupBy("query_id", "memory_id").agg(F.min("distance").alias("distance"), F.max("lexical").alias("lexical"), F.max("graph").alias("graph"))
    rows = memories.select(F.col("id").alias("memory_id"), "content", "category", "importance", "access_count", "state", "confidence", "created_at", "last_accessed", "is_contradicted", "contradicted_by_id")
    # a memory is in the pools of several queries: its words are cut once
    rows = rows.join(pool.select("memory_id").distinct(), "memory_id", "left_semi").withColumn("mt", X.tokens(F.col("content")))
    asked = q.select("query_id", "query", X.tokens(F.col("query")).alias("qt"), X.query_terms(F.col("query")).alias("terms"), X.query_category(F.col("query")).alias("asked"))
    j = pool.join(rows, "memory_id").join(asked, "query_id")
    signals = {
        "semantic": F.when(F.col("distance").isNotNull(), S.similarity(F.col("distance"))),
        "lexical": X.lexical_score(F.col("mt"), F.col("qt"), F.col("terms")),
        "graph": F.col("graph").cast("double"),
        "importance": S.importance_signal(F.col("importance")),
        "recency": S.recency(F.col("last_accessed"), F.col("created_at"), as_of),
        "access": S.access(F.col("access_count")),
        "category": F.coalesce((F.col("category") == F.col("asked")).cast("double"), F.lit(0.0)),
    }
    j = j.select("query_id", "query", "memory_id", "content", "category", "state", "confidence", "created_at", "is_contradicted", "contradicted_by_id", "distance", F.col("lexical").alias("in_words"), *[c.alias(f"{n}_score") for n, c in signals.items()])
    score = S.hybrid({n: F.col(f"{n}_score") for n in signals}, F.col("is_contradicted"))
    reasons = F.array_compact(F.array(F.when(F.col("distance").isNotNull(), "semantic_match"), F.when(F.col("in_words"), "lexical_match"), F.when(F.col("graph_score") > 0, "graph_entity_match"), F.when(F.col("state") == "archived", "archived_included_for_history")))
    # equal sums may differ in their last bits: scores are compared to twelve digits
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.col("distance").asc_nulls_last(), "memory_id")
    return j.withColumn("score", score).withColumn("reasons", F.array_join(reasons, ",")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("in_words")


#: Similarity from which the nearest memory counts as the same statement.
DUPLICATE = 0.90


def duplicate_or_new(statements: DataFrame, memories: DataFrame, pool: int = 5) -> DataFrame:
    """(query_id, kind, memory_id, importance, access_count): what a statement is by its nearest live memory alone.

    A ``duplicate`` comes with the memory's counters strengthened, a ``new`` one with none. ``statements``
    has query_id, tenant and embedding; a memory of the same id is not its own duplicate.
    """
    near = semantic_pool(statements, memories, pool + 1).where("query_id <> memory_id AND distance IS NOT NULL")
    best = near.groupBy("query_id").agg(F.min(F.struct("distance", "memory_id")).alias("b")).where(F.round(1 - F.col("b.distance"), 12) >= DUPLICATE)
    hit = best.select("query_id", F.col("b.memory_id").alias("memory_id"))
    m = memories.select(F.col("id").alias("memory_id"), F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.5)) + 0.05).alias("importance"), (F.coalesce("access_count", F.lit(0)) + 1).alias("access_count"))
    j = statements.select("query_id").join(hit.join(m, "memory_id"), "query_id", "left")
    return j.select("query_id", F.when(F.col("memory_id").isNotNull(), "duplicate").otherwise("new").alias("kind"), "memory_id", "importance", "access_count")
