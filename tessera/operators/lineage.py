"""Lineage links, provenance and contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.hierarchy import LINEAGE_TYPES, type_form

#: A memory with one of these outgoing links describes the past.
HISTORICAL_TYPES = ("superseded_by", "fulfilled_by")


def typed(links: DataFrame) -> DataFrame:
    """Links with one spelling of each type."""
    return links.withColumn("relationship_type", type_form(F.col("relationship_type")))


def historical_ids(links: DataFrame) -> DataFrame:
    """(memory_id): memories with a historical link, each once."""
    t = typed(links).where(F.col("relationship_type").isin(*HISTORICAL_TYPES) & F.col("source_memory_id").isNotNull())
    return t.select(F.col("source_memory_id").alias("memory_id")).distinct()


def distinct_links(links: DataFrame) -> DataFrame:
    """(id, source_memory_id, target_memory_id, relationship_type): the least id of each edge.

    Links with a null end and links to itself are left out.
    """
    t = typed(links).where("source_memory_id IS NOT NULL AND target_memory_id IS NOT NULL AND source_memory_id <> target_memory_id")
    return t.groupBy("source_memory_id", "target_memory_id", "relationship_type").agg(F.min("id").alias("id"))


def insert_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``incoming`` whose key is new, each key once: an insert that skips conflicts."""
    return incoming.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def dangling(links: DataFrame, memories: DataFrame) -> DataFrame:
    """(relationship_type, links): links whose target is no memory."""
    ids = memories.select(F.col("id").alias("target_memory_id"))
    lost = typed(links).where("target_memory_id IS NOT NULL").join(ids, "target_memory_id", "left_anti")
    return lost.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("links"))


def pairs_with_contents(links: DataFrame, memories: DataFrame) -> DataFrame:
    """(relationship_type, source, target): contents at both ends of lineage links, null where lost."""
    e = distinct_links(links).where(F.col("relationship_type").isin(*LINEAGE_TYPES))
    m = memories.select("id", "content")
    s = m.select(F.col("id").alias("source_memory_id"), F.col("content").alias("source"))
    t = m.select(F.col("id").alias("target_memory_id"), F.col("content").alias("target"))
    return e.join(s, "source_memory_id", "left").join(t, "target_memory_id", "left").select("relationship_type", "source_memory_id", "target_memory_id", "source", "target")


def contradictions(memories: DataFrame) -> DataFrame:
    """(memory_id, contradicted_by_id, content, by_content): contradicted memories and what does it."""
    by = memories.select(F.col("id").alias("contradicted_by_id"), F.col("content").alias("by_content"))
    c = memories.where("coalesce(is_contradicted, false)").select(F.col("id").alias("memory_id"), "contradicted_by_id", "content")
    return c.join(by, "contradicted_by_id", "left").select("memory_id", "contradicted_by_id", "content", "by_content")


def evidence_view(evidence: DataFrame, memories: DataFrame, links: DataFrame) -> DataFrame:
    """(memory_id, kind, at, ref, decision, other_content): evidence and lineage of the live memories.

    Repeated evidence rows count once. Order by (at, ref) within a memory where it matters; the content
    of a lost other end is empty.
    """
    ids = memories.where("state <> 'archived'").select(F.col("id").alias("memory_id"))
    e = evidence.select("memory_id", F.lit("evidence").alias("kind"), F.col("observed_at").alias("at"), F.col("id").alias("ref"), "decision", F.lit("").alias("other_content")).distinct()
    m = memories.select("id", "content")
    l = pairs_with_contents(links, m)
    out = l.select(F.col("source_memory_id").alias("memory_id"), F.lit("outgoing").alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.col("target_memory_id").alias("ref"), F.col("relationship_type").alias("decision"), F.coalesce("target", F.lit("")).alias("other_content"))
    in_ = l.select(F.col("target_memory_id").alias("memory_id"), F.lit("incoming").alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.col("source_memory_id").alias("ref"), F.col("relationship_type").alias("decision"), F.coalesce("source", F.lit("")).alias("other_content"))
    return e.unionByName(out).unionByName(in_).join(ids, "memory_id", "left_semi")


def links_per_memory(links: DataFrame) -> DataFrame:
    """(memory_id, relationship_type, outgoing, incoming): counts of distinct links, both directions."""
    e = distinct_links(links)
    o = e.select(F.col("source_memory_id").alias("memory_id"), "relationship_type", F.lit(1).alias("o"), F.lit(0).alias("i"))
    i = e.select(F.col("target_memory_id").alias("memory_id"), "relationship_type", F.lit(0).alias("o"), F.lit(1).alias("i"))
    return o.unionByName(i).groupBy("memory_id", "relationship_type").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def neighbours(links: DataFrame, memory_id: int) -> DataFrame:
    """Outgoing links of one memory."""
    return typed(links).where(F.col("source_memory_id") == memory_id)
