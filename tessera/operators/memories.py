"""Selections, duplicates, merges and checks over the memory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scoring as S
from tessera.functions import text as X


def live(memories: DataFrame, include_archived: bool = False) -> DataFrame:
    """Rows that are not archived; a null state is not live. With ``include_archived`` all rows."""
    return memories if include_archived else memories.where("state <> 'archived'")


def listing(memories: DataFrame, category: str | None = None, min_importance: float | None = None, keyword: str | None = None, record_access: bool = False) -> DataFrame:
    """Live rows by category, importance and case-blind substring (``%`` and ``_`` are wildcards).

    Ordered by importance, ids break ties. ``record_access`` counts the access and moves the state.
    """
    m = live(memories)
    if category is not None:
        m = m.where(F.col("category") == category)
    if min_importance is not None:
        m = m.where(F.col("importance") >= min_importance)
    if keyword is not None:
        m = m.where(F.col("content").ilike(f"%{keyword}%"))
    if record_access:
        n = F.coalesce("access_count", F.lit(0)) + 1
        m = m.withColumn("access_count", n)
        m = m.withColumn("state", S.decayed(S.lifecycle(F.col("state"), F.col("access_count")), F.col("importance"), F.col("access_count")))
    return m.orderBy(F.desc_nulls_last("importance"), "id")


def by_id(memories: DataFrame, memory_id: int) -> DataFrame:
    """The row with the id; LookupError if there is none."""
    m = memories.where(F.col("id") == memory_id)
    if m.limit(1).count() == 0:
        raise LookupError(f"no memory {memory_id}")
    return m


def check_version(memories: DataFrame, memory_id: int, expected: int) -> None:
    """ValueError unless the row still has the version that the caller saw."""
    if by_id(memories, memory_id).select("version").first()[0] != expected:
        raise ValueError(f"memory {memory_id} has changed since version {expected}")


def top_by_importance(memories: DataFrame, k: int, keyword: str | None = None) -> DataFrame:
    """The k most important live rows of each tenant; ranks are cut before the shuffle."""
    m = live(memories)
    if keyword is not None:
        m = m.where(F.col("content").ilike(f"%{keyword}%"))
    w = Window.partitionBy("tenant").orderBy(F.desc_nulls_last("importance"), "id")
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_duplicates(memories: DataFrame, historical: DataFrame) -> DataFrame:
    """(tenant, content, keeper, copies): contents that several rows of a tenant state.

    Rows in ``historical`` (memory_id) are left out; the keeper is the first live row by id, else the
    first archived one. A partial aggregate, so a content in a third of all rows is no hot group.
    """
    m = memories.where("content IS NOT NULL").join(historical.select(F.col("memory_id").alias("id")), "id", "left_anti")
    first = F.min(F.struct((F.coalesce("state", F.lit("")) == "archived").alias("old"), "id"))
    g = m.groupBy("tenant", "content").agg(first.alias("f"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return g.select("tenant", "content", F.col("f.id").alias("keeper"), "copies")


def merged_groups(memories: DataFrame) -> DataFrame:
    """(tenant, content, confidence, access_count, created_at, rows): what a merge of equal contents keeps.

    Confidence is the greatest plus 0.05, not over 1; accesses add up and count the merge; the oldest
    creation stays.
    """
    m = memories.where("content IS NOT NULL")
    return m.groupBy("tenant", F.lower(F.trim("content")).alias("content")).agg(
        F.least(F.lit(1.0), F.max("confidence") + 0.05).alias("confidence"),
        (F.sum("access_count") + 1).alias("access_count"),
        F.min("created_at").alias("created_at"),
        F.count(F.lit(1)).alias("rows"),
    )


def buckets(memories: DataFrame, limit: int) -> DataFrame:
    """(tenant, profile, preferences, habits, events, other): contents by category, best first.

    Only the ``limit`` most important live rows of a tenant are gathered, so an array has a fixed bound.
    """
    m = top_by_importance(memories, limit)
    kinds = {"profile": "profile", "preferences": "preference", "habits": "habit", "events": "event"}
    pick = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("rank", "content")))), lambda r: r["content"])
    category = F.coalesce("category", F.lit(""))
    named = [pick(category == v).alias(k) for k, v in kinds.items()]
    return m.groupBy("tenant").agg(*named, pick(~category.isin(*kinds.values())).alias("other"))


def violations(memories: DataFrame) -> DataFrame:
    """(check, rows): rows that break each rule of the table."""
    rules: dict[str, Column] = {
        "state": ~F.col("state").isin("active", "weak", "archived"),
        "self_contradiction": F.col("contradicted_by_id") == F.col("id"),
        "embedding_width": F.size("embedding") != 64,
        "content_missing": F.col("content").isNull(),
    }
    one = memories.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in rules]), F.array(*[F.col(k) for k in rules]))).alias("check", "rows"))


def missing_embeddings(memories: DataFrame) -> DataFrame:
    return memories.where("embedding IS NULL")


def backfill_embeddings(memories: DataFrame, embed: Column) -> DataFrame:
    """Rows with ``embed`` where there was no embedding; ``embed`` is any vector expression or pandas UDF."""
    return memories.withColumn("embedding", F.when(F.col("embedding").isNull(), embed).otherwise(F.col("embedding")))


def reflected(memories: DataFrame, used: DataFrame) -> DataFrame:
    """Counters of the rows used in an answer: one access more, importance + 0.02 up to 1."""
    u = used.select(F.col("memory_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    m = memories.join(u, "id", "left")
    hit = F.coalesce("hit", F.lit(False))
    return m.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + hit.cast("int")).withColumn("importance", F.when(hit, F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.5)) + 0.02)).otherwise(F.col("importance"))).drop("hit")


def statement_frame(memories: DataFrame) -> DataFrame:
    """What a statement says by rules alone: intent, category asked for, cues, importance of the intent."""
    c = F.col("content")
    return memories.select(
        "id",
        X.intent(c).alias("intent"),
        X.query_category(c).alias("query_category"),
        X.temporal_intent(c).alias("temporal_intent"),
        S.category_importance(X.intent(c)).alias("importance"),
    )
