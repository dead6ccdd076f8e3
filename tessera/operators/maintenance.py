"""Corrections, archiving and purging as pure functions from tables to tables; checks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators import lineage as L
from tessera.operators.fact_index import current

EVIDENCE = ["memory_id", "source_type", "observed_at", "raw_text", "previous_text", "decision"]


def evidence_rows(changed: DataFrame, decision: str, at: str) -> DataFrame:
    """Evidence of an administrative change: ``changed`` has memory_id, raw_text and previous_text."""
    return changed.select("memory_id", F.lit("admin").alias("source_type"), F.lit(at).cast("timestamp").alias("observed_at"), "raw_text", "previous_text", F.lit(decision).alias("decision"))


def corrected(memories: DataFrame, corrections: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(memories, evidence) after new contents (id, content, expected_version, embedding) were put in.

    A row whose version is not the expected one is left as it is (null expects any). Lineage is not
    touched; the fact of a corrected row is derived anew by the index upkeep, as its hash differs.
    """
    c = corrections.select("id", F.col("content").alias("new"), "expected_version", F.col("embedding").alias("new_embedding"))
    j = memories.join(c, "id", "left")
    fits = F.col("new").isNotNull() & (F.col("expected_version").isNull() | (F.col("expected_version") == F.col("version")))
    evidence = evidence_rows(j.where(fits).select(F.col("id").alias("memory_id"), F.col("new").alias("raw_text"), F.col("content").alias("previous_text")), "ADMIN_UPDATE", at)
    out = j.withColumns({"embedding": F.when(fits, F.col("new_embedding")).otherwise(F.col("embedding")), "version": F.when(fits, F.col("version") + 1).otherwise(F.col("version")), "content": F.when(fits, F.col("new")).otherwise(F.col("content"))})
    return out.select(*memories.columns), evidence


def archived(memories: DataFrame, ids: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(memories, evidence) after the memories in ``ids`` (id) were archived; archived ones stay as they are."""
    j = memories.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    change = F.coalesce(F.col("hit") & (F.coalesce("state", F.lit("")) != "archived"), F.lit(False))
    evidence = evidence_rows(j.where(change).select(F.col("id").alias("memory_id"), F.col("content").alias("raw_text"), F.col("content").alias("previous_text")), "ADMIN_ARCHIVE", at)
    out = j.withColumns({"version": F.when(change, F.col("version") + 1).otherwise(F.col("version")), "state": F.when(change, "archived").otherwise(F.col("state"))})
    return out.select(*memories.columns), evidence


def _losses(tables: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """(memory_id, purged, code): links of memories that stay to memories in ``gone`` (id)."""
    on = lambda c: gone.select(F.col("id").alias(c))
    lost = []
    if "memory_relationships" in tables:
        r = L.typed(tables["memory_relationships"])
        for mine, other, way in (("source_memory_id", "target_memory_id", "outgoing"), ("target_memory_id", "source_memory_id", "incoming")):
            lost.append(r.join(on(other), other).select(F.col(mine).alias("memory_id"), F.col(other).alias("purged"), F.concat("relationship_type", F.lit(f":{way}")).alias("code")))
    if "memories" in tables:
        lost.append(tables["memories"].join(on("contradicted_by_id"), "contradicted_by_id").select(F.col("id").alias("memory_id"), F.col("contradicted_by_id").alias("purged"), F.lit("contradicted_by:outgoing").alias("code")))
    every = gone.sparkSession.createDataFrame([], "memory_id bigint, purged bigint, code string")
    for x in lost:
        every = every.unionByName(x)
    return every.where("memory_id IS NOT NULL").join(on("memory_id"), "memory_id", "left_anti")


def purged(tables: dict[str, DataFrame], ids: DataFrame, at: str = "1970-01-01", edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without the memories in ``ids`` (id) and all that hangs on them.

    ``tables`` has any of memories, memory_relationships, memory_evidence, knowledge_facts,
    memory_entities, entities and entity_aliases. Pointers of contradicted rows to a purged memory become
    null. Entities that no memory, alias or edge needs any more go; aliased ones stay. ``edges`` (source_id,
    target_id, memory_id) are the graph's edges; those of purged memories go first, and the others come
    back as ``edges``. The version of a memory goes up for each purged one it was linked to, and ``evidence``
    has a row for each of these, with codes ``purged_memory:id`` and ``type:outgoing`` or ``type:incoming``.
    """
    gone = ids.select("id").distinct()
    on = lambda c: gone.select(F.col("id").alias(c))
    out = dict(tables)
    codes = _losses(tables, gone).groupBy("memory_id", "purged").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    out["evidence"] = codes.select("memory_id", F.lit("admin").alias("source_type"), F.lit(at).cast("timestamp").alias("observed_at"), F.lit("lineage_removed_by_purge").alias("decision"), F.concat(F.array(F.concat(F.lit("purged_memory:"), "purged")), "codes").alias("reason_codes"))
    if "memories" in out:
        n = codes.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("__n"))
        m = out["memories"].join(gone, "id", "left_anti").join(n, "id", "left")
        m = m.withColumn("version", (F.col("version") + F.coalesce("__n", F.lit(0))).cast("int"))
        m = m.join(on("contradicted_by_id").withColumn("__lost", F.lit(True)), "contradicted_by_id", "left").withColumn("contradicted_by_id", F.when(F.col("__lost").isNull(), F.col("contradicted_by_id")))
        out["memories"] = m.select(*tables["memories"].columns)
    if "memory_relationships" in out:
        r = out["memory_relationships"]
        out["memory_relationships"] = r.join(on("source_memory_id"), "source_memory_id", "left_anti").join(on("target_memory_id"), "target_memory_id", "left_anti").select(*r.columns)
    for name in ("memory_evidence", "knowledge_facts", "memory_entities"):
        if name in out:
            out[name] = out[name].join(on("memory_id"), "memory_id", "left_anti").select(*tables[name].columns)
    if edges is not None:
        out["edges"] = graph.unlinked(edges, gone)
    if "entities" in out and "memory_entities" in out:
        none = gone.sparkSession.createDataFrame([], "entity_id bigint, source_id bigint, target_id bigint")
        orphan = graph.orphans(out["entities"], out["memory_entities"], out.get("edges", none), out.get("entity_aliases", none))
        out["entities"] = out["entities"].join(orphan, "id", "left_anti").select(*tables["entities"].columns)
    return out


def deleted(tables: dict[str, DataFrame], ids: DataFrame, at: str, purge: bool = False) -> dict[str, DataFrame]:
    """Delete memories: archive them unless ``purge`` says to remove them for good. New evidence comes as ``evidence``."""
    if purge:
        return purged(tables, ids, at)
    memories, evidence = archived(tables["memories"], ids, at)
    return {**tables, "memories": memories, "evidence": evidence}


def relinked(memory_entities: DataFrame, edges: DataFrame, ids: DataFrame, links: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memory_entities, edges) after the texts of ``ids`` (id) changed: what they said goes, what they say comes."""
    return graph.unlinked(memory_entities, ids).unionByName(links.select(*memory_entities.columns)), graph.unlinked(edges, ids).unionByName(new_edges.select(*edges.columns))


def legacy_evidence(memories: DataFrame, evidence: DataFrame) -> DataFrame:
    """A first evidence row for each memory that has none."""
    none = memories.join(evidence.select(F.col("memory_id").alias("id")), "id", "left_anti")
    return none.select(F.col("id").alias("memory_id"), F.lit("legacy").alias("source_type"), F.col("created_at").alias("observed_at"), F.col("content").alias("raw_text"), F.lit(None).cast("string").alias("previous_text"), F.lit("LEGACY").alias("decision"))


def conflict_report(memories: DataFrame, feed: DataFrame, links: DataFrame) -> DataFrame:
    """(tenant, entity_key, attribute_key, values): single-valued domains with several live current values."""
    live = memories.where("state <> 'archived' AND NOT coalesce(is_contradicted, false)").select(F.col("id").alias("memory_id"))
    f = current(feed).where("single_valued AND NOT is_placeholder AND NOT is_negated AND temporal_state = 'CURRENT'")
    f = f.join(live, "memory_id", "left_semi").join(L.historical_ids(links), "memory_id", "left_anti")
    return f.groupBy("tenant", "entity_key", "attribute_key").agg(F.count_distinct("value_key").alias("values")).where("values > 1")


def validate(memories: DataFrame, width: int) -> None:
    """ValueError if a table misses columns or the model's vectors have another width than the stored ones."""
    missing = {"id", "tenant", "content", "embedding", "state"} - set(memories.columns)
    if missing:
        raise ValueError(f"memories lacks {sorted(missing)}")
    stored = memories.where("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count")).first()
    if stored and stored["n"] != width:
        raise ValueError(f"vectors of {width} values do not fit stored ones of {stored['n']}")


def report_json(report: DataFrame) -> DataFrame:
    """(json): each row as one JSON text."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("json"))
