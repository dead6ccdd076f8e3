"""The derived fact index: current rows, candidates in a domain, upkeep and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import extraction, scoring
from tessera.functions import text as X
from tessera.scale import carry_last, carry_next, materialize, ordered_chunks

KEYS = ["tenant", "entity_key", "attribute_key"]
DERIVED = ["tenant", "entity_key", "attribute_key", "value_key", "value_text", "fact_type", "single_valued", "temporal_state", "is_negated", "is_placeholder", "confidence", "content_sha256", "extractor_version"]


def current(feed: DataFrame) -> DataFrame:
    """One row for each memory_id: the latest of the feed, ties by the greatest other columns.

    A partial aggregate, so a memory_id repeated without end is no hot group.
    """
    cols = [c for c in feed.columns if c not in ("memory_id", "updated_at")]
    f = feed.where("memory_id IS NOT NULL").groupBy("memory_id").agg(F.max(F.struct("updated_at", *cols)).alias("r"))
    return f.select("memory_id", "r.*")


def usable(index: DataFrame, memories: DataFrame, historical: DataFrame) -> DataFrame:
    """Index rows that may still compete: stated by a live, uncontradicted memory without historical link."""
    ok = memories.where("state <> 'archived' AND NOT coalesce(is_contradicted, false)").select(F.col("id").alias("memory_id"))
    return index.where("NOT coalesce(is_placeholder, false)").join(ok, "memory_id", "left_semi").join(historical, "memory_id", "left_anti")


def structural_candidates(index: DataFrame, memories: DataFrame, historical: DataFrame, limit: int) -> DataFrame:
    """(.., memory_id, rank, truncated, supported): the newest ``limit`` usable rows of each fact domain.

    Single-valued attributes compete by (entity, attribute), others by the value as well. ``truncated``
    tells that more rows match; ``supported`` that the memory's content is still the one derived from.
    Ranks are cut before the shuffle, so a hot domain costs ``limit`` rows from each task.
    """
    u = usable(index, memories, historical)
    value = F.when(F.coalesce("single_valued", F.lit(False)), "").otherwise(F.col("value_key"))
    w = Window.partitionBy(*KEYS, "domain_value")
    ranked = u.withColumn("domain_value", value).withColumn("rank", F.row_number().over(w.orderBy(F.desc("memory_id")))).where(F.col("rank") <= limit + 1)
    ranked = ranked.withColumn("truncated", F.max("rank").over(w) > limit).where(F.col("rank") <= limit)
    now = memories.select(F.col("id").alias("memory_id"), F.sha2("content", 256).alias("sha"))
    return ranked.join(now, "memory_id").select(*KEYS, "domain_value", "memory_id", "rank", "truncated", F.coalesce(F.col("sha") == F.col("content_sha256"), F.lit(False)).alias("supported"))


def lookup(index: DataFrame, entity: str, attribute: str, value: str | None = None, placeholders: bool = False) -> DataFrame:
    """Rows of one key (any tenant)."""
    out = index.where((F.col("entity_key") == entity) & (F.col("attribute_key") == attribute))
    if value is not None:
        out = out.where(F.col("value_key") == value)
    return out if placeholders else out.where("NOT coalesce(is_placeholder, false)")


def live_fact_counts(index: DataFrame, memories: DataFrame, historical: DataFrame) -> DataFrame:
    """(tenant, entity_key, attribute_key, value_key, memories)."""
    return usable(index, memories, historical).groupBy(*KEYS, "value_key").agg(F.count(F.lit(1)).alias("memories"))


def upkeep(index: DataFrame, memories: DataFrame, version: str) -> DataFrame:
    """(memory_id, status): unchanged, stale (other content or extractor), missing memory or not indexed."""
    m = memories.select(F.col("id").alias("memory_id"), F.sha2("content", 256).alias("sha"))
    j = index.select("memory_id", "content_sha256", "extractor_version").join(m, "memory_id", "full_outer")
    stale = (F.col("content_sha256") != F.col("sha")) | (F.col("extractor_version") != version)
    status = F.when(F.col("sha").isNull(), "unexpected").when(F.col("content_sha256").isNull(), "missing").when(stale, "stale").otherwise("unchanged")
    return j.select("memory_id", status.alias("status"))


def upkeep_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("memories"))


def upsert(index: DataFrame, derived: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index after new rows replaced those of their memory_id and ``gone`` (memory_id) was removed."""
    kept = index.join(derived.select("memory_id"), "memory_id", "left_anti")
    if gone is not None:
        kept = kept.join(gone.select("memory_id"), "memory_id", "left_anti")
    return kept.unionByName(derived)


#: Longest keys; a fact with a longer one has no row.
KEY_LIMITS = {"entity_key": 255, "attribute_key": 128, "value_key": 255}


def derived(memories: DataFrame, version: str) -> DataFrame:
    """(memory_id, DERIVED..): the index row of each memory whose content states a fact.

    None for questions, for texts without a told attribute, and where a key is empty or too long. Facts
    that stand for something said elsewhere have a row, marked as placeholder.
    """
    f = materialize(memories.where("id IS NOT NULL AND length(trim(content)) > 0").select(F.col("id").alias("memory_id"), "tenant", "content", extraction.facts(F.col("content")).alias("f")))
    single = scoring.single_valued(F.col("f.attribute"), F.col("f.fact_type"))
    keys = {f"{k}_key": X.fact_key(F.col(f"f.{k}")) for k in ("entity", "attribute", "value")}
    r = f.where(f"f.attribute IS NOT NULL AND f.attribute <> '{extraction.NO_ATTRIBUTE}' AND NOT f.is_question").select("memory_id", "tenant", *[c.alias(k) for k, c in keys.items()], F.col("f.value").alias("value_text"), "f.fact_type", single.alias("single_valued"), "f.temporal_state", "f.is_negated", "f.is_placeholder", "f.confidence", F.sha2("content", 256).alias("content_sha256"), F.lit(version).alias("extractor_version"))
    fits = F.lit(True)
    for k, n in KEY_LIMITS.items():
        fits = fits & (F.length(k) <= n)
    return r.where(fits & (F.length("entity_key") > 0) & (F.length("attribute_key") > 0)).select("memory_id", *DERIVED)


def reindexed(index: DataFrame, memories: DataFrame, version: str, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """(index, changes): the index brought up to the memories' contents, and what became of each memory.

    ``index`` has one row for each memory_id. Only memories whose row is missing or stale (another content
    or extractor) are derived anew, all of them with ``everything``. changes: (memory_id, status), written,
    deleted (a row whose content states no fact any more, or whose memory is gone), none (no row, no fact) or
    unchanged.
    """
    status = materialize(upkeep(index, memories, version))
    todo = status.where("status <> 'unexpected'" if everything else "status IN ('stale', 'missing')").select("memory_id")
    new = materialize(derived(memories.join(todo.withColumnRenamed("memory_id", "id"), "id", "left_semi"), version))
    touched = todo.unionByName(status.where("status = 'unexpected'").select("memory_id"))
    kept = index.select("memory_id", *DERIVED).join(touched, "memory_id", "left_anti")
    had, wrote = index.select("memory_id", F.lit(True).alias("had")), new.select("memory_id", F.lit(True).alias("wrote"))
    c = touched.join(had, "memory_id", "left").join(wrote, "memory_id", "left")
    c = c.select("memory_id", F.when(F.col("wrote"), "written").when(F.col("had"), "deleted").otherwise("none").alias("status"))
    return kept.unionByName(new), c.unionByName(kept.select("memory_id", F.lit("unchanged").alias("status")))


def consistency(index: DataFrame, memories: DataFrame, version: str) -> DataFrame:
    """(memory_id, problem): rows that differ from what all contents derive: missing, unexpected or stale."""
    want = derived(memories, version)
    same = F.lit(True)
    for c in DERIVED:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    j = want.alias("a").join(index.alias("b"), F.col("a.memory_id") == F.col("b.memory_id"), "full_outer")
    problem = F.when(F.col("b.memory_id").isNull(), "missing").when(F.col("a.memory_id").isNull(), "unexpected").when(~same, "stale")
    return j.select(F.coalesce("a.memory_id", "b.memory_id").alias("memory_id"), problem.alias("problem")).where("problem IS NOT NULL")


def contradicted(index: DataFrame) -> DataFrame:
    """(memory_id, contradicted_id): of each current claim the newest earlier claim that it contradicts.

    Claims are single-valued, current, not negated and no placeholder; two of one domain with different values
    contradict each other, and ids tell which is earlier. Taken over ordered chunks by carrying the end of the
    last run of another value, so a hot domain is neither gathered nor compared pair by pair.
    """
    c = index.where("single_valued AND NOT is_placeholder AND NOT is_negated AND temporal_state = 'CURRENT' AND value_key IS NOT NULL").select("memory_id", *KEYS, "value_key")
    d = ordered_chunks(c, KEYS, ["memory_id"])
    d = carry_next(d, KEYS, ["memory_id"], "following", F.struct("value_key"))
    ends = F.col("following").isNotNull() & (F.col("following.value_key") != F.col("value_key"))
    d = carry_last(d, KEYS, ["memory_id"], "contradicted_id", F.when(ends, F.col("memory_id")))
    return d.where("contradicted_id IS NOT NULL").select("memory_id", "contradicted_id")
