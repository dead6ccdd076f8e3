"""Queries of extraction and evolution.

The SQL of the two labelled queries is a list of golden labels, not an independent computation; the
queries over whole tables have none, as a fold over parsed text has no SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import extraction
from tessera.operators import evolution as E
from tessera.operators import fact_index as FI
from tessera.operators import memories as M
from tessera.operators import retrieval as R
from tessera.plans import store_queries as SQ
from tessera.plans import text_queries as TQ
from tessera.plans.labelled import FACTS, TIMELINES
from tessera.scale import materialize
from tessera.sources.tables import table

def labelled_facts(spark: SparkSession, d: str) -> DataFrame:
    f = spark.createDataFrame([(t,) for t, *_ in FACTS], "text string").withColumn("f", extraction.facts(F.col("text")))
    return f.select("text", "f.entity", "f.attribute", "f.value", "f.temporal_state")


def labelled_links(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t.name, i, s, t.category) for t in TIMELINES for i, s in enumerate(t.statements, 1)]
    return E.links(E.evolve(spark.createDataFrame(rows, "tenant string, seq bigint, content string, category string")))


def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").select("id", extraction.facts(F.col("content")).alias("f"))
    return m.where("f.entity IS NOT NULL").select("id", "f.*")


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """Every memory as a statement, in the order of its id, tenant by tenant; unusable vectors are null."""
    return table(spark, d, "memories").select("tenant", F.col("id").alias("seq"), "content", "category", F.when(R.usable(), F.col("embedding")).alias("embedding"), F.col("created_at").alias("observed_at"))


def evolution_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every memory if all are stated again with their vectors."""
    return E.decisions(E.evolve(_statements(spark, d))).withColumn("reason_codes", F.array_join("reason_codes", ","))


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _statements(spark, d)
    return s, materialize(E.decisions(E.evolve(s)))


def evolution_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = E.evidence(*_decided(spark, d), VERSION)
    return e.withColumn("reason_codes", F.array_join("reason_codes", ","))


def evolution_links(spark: SparkSession, d: str) -> DataFrame:
    """Links from memories to the entities that their statements name."""
    return E.graph_changes(*_decided(spark, d))[1]


def evolution_edges(spark: SparkSession, d: str) -> DataFrame:
    """Typed edges between entities, with the memory that each rests on."""
    return E.graph_changes(*_decided(spark, d))[2]


def reindexed(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each memory's index row if missing and stale rows are derived anew."""
    index = FI.current(table(spark, d, "knowledge_facts"))
    return FI.reindexed(index, table(spark, d, "memories"), SQ.VERSION)[1]


def statement_frames(spark: SparkSession, d: str) -> DataFrame:
    return M.statement_frame(table(spark, d, "memories"))


QUERIES = {f.__name__: f for f in (labelled_facts, labelled_links, extracted_facts, evolution_decisions, evolution_evidence, evolution_links, evolution_edges, reindexed, statement_frames)}
VERSION = "rules-1.6"


def _values(rows, columns: str) -> str:
    one = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({columns})"


SQL = {
    "labelled_facts": _values(FACTS, "text, entity, attribute, value, temporal_state"),
    "labelled_links": _values([(t.name, *link, kind) for t in TIMELINES for kind, links in (("superseded_by", t.superseded), ("fulfilled_by", t.fulfilled)) for link in links], "tenant, source_memory_id, target_memory_id, relationship_type"),
    "statement_frames": f"SELECT id, intent, {TQ.sql_query_category('content')} AS query_category, {TQ.sql_temporal_intent('content')} AS temporal_intent, CASE intent WHEN 'profile' THEN 0.95::DOUBLE WHEN 'preference' THEN 0.80::DOUBLE WHEN 'habit' THEN 0.70::DOUBLE WHEN 'event' THEN 0.50::DOUBLE ELSE 0.40::DOUBLE END AS importance FROM (SELECT id, content, {TQ._INTENT} AS intent FROM memories)",
}
