"""The labelled timelines told, asked about and judged: the quality of extraction, evolution, graph and context.

Every timeline is a tenant of its own, so all are told in one fold and asked in one retrieval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import extraction
from tessera.functions import text as X
from tessera.functions.embedding import Provider, embedded, hashed_words
from tessera.operators import context as C
from tessera.operators import evaluation as V
from tessera.operators import evolution as E
from tessera.operators import fact_index as FI
from tessera.operators import retrieval as R
from tessera.plans.labelled import FACTS, QUALITY, TIMELINES
from tessera.scale import materialize

K = 3
AS_OF = "2025-06-01 00:00:00"
VERSION = "rules-1.6"


def _frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The labels as frames. A statement's seq is unique over all timelines; labels tell statements by their text."""
    seq, said, asked, right, wrong, pairs, edges, facts = 0, [], [], [], [], [], [], []
    for t in TIMELINES:
        text = dict(enumerate(t.statements, 1))
        for s in t.statements:
            seq += 1
            said.append((t.name, seq, s, t.category))
        for q, relevant, forbidden in t.questions:
            asked.append((len(asked) + 1, t.name, q))
            right += [(len(asked), text[i]) for i in relevant]
            wrong += [(len(asked), text[i]) for i in forbidden]
        for kind, links in (("superseded_by", t.superseded), ("contradicted", t.contradicted)):
            pairs += [(kind, f"{t.name}|{text[a]}", f"{t.name}|{text[b]}") for a, b in links]
        edges += [(t.name, *e, True) for e in t.edges] + [(t.name, *e, False) for e in t.no_edges]
        facts += [(t.name, *f) for f in t.facts]
    df = spark.createDataFrame
    return {
        "statements": df(said, "tenant string, seq bigint, content string, category string"),
        "questions": df(asked, "query_id bigint, tenant string, query string"),
        "relevant": df(right, "query_id bigint, item string"),
        "forbidden": df(wrong, "query_id bigint, item string"),
        "pairs": df(pairs, "kind string, a string, b string"),
        "edges": df(edges, "tenant string, source string, relationship string, target string, present boolean"),
        "facts": df(facts, "tenant string, entity_key string, attribute_key string, value_key string"),
        "sentences": df(FACTS, "text string, entity string, attribute string, value string, temporal_state string"),
    }


def told(statements: DataFrame, provider: Provider, width: int) -> dict[str, DataFrame]:
    """Memories (with vectors), lineage, graph and fact index after the statements were folded in."""
    s = materialize(statements.withColumn("embedding", embedded(F.col("content"), provider, width)))
    records = materialize(E.evolve(s))
    m = E.memories(records).withColumn("embedding", embedded(F.col("content"), provider, width)).withColumn("created_at", F.lit(AS_OF).cast("timestamp")).withColumn("last_accessed", F.lit(None).cast("timestamp"))
    entities, links, edges = E.graph_changes(s, E.decisions(records))
    ids = entities.select("tenant", "name", F.xxhash64("tenant", "name").alias("id"), "entity_type")
    return {"memories": materialize(m), "links": E.links(records), "decisions": E.decisions(records), "entities": ids, "memory_entities": links.join(ids.select("tenant", "name", F.col("id").alias("entity_id")), ["tenant", "name"]).select("memory_id", "entity_id", "role"), "edges": edges}


def selected(questions: DataFrame, store: dict[str, DataFrame], provider: Provider, width: int) -> DataFrame:
    """The context of each question: what it asks for is read from its text."""
    q = questions.withColumn("embedding", embedded(F.col("query"), provider, width)).withColumn("past", X.temporal_intent(F.col("query")) == "HISTORICAL")
    q = materialize(q.withColumn("a", extraction.asked(F.col("query"))))
    none = questions.sparkSession.createDataFrame([], "alias_normalized string, entity_id bigint")
    named = store["entities"].select(F.col("name").alias("normalized_name"), "id", "tenant")
    found = R.candidates(q, store["memories"], named, none, store["memory_entities"], AS_OF)
    historical = store["links"].where("relationship_type IN ('superseded_by', 'fulfilled_by')").select(F.col("source_memory_id").alias("memory_id")).distinct()
    facts = q.select("query_id", F.col("a.entity").alias("q_entity"), F.col("a.attribute").alias("q_attribute"))
    return C.build(found, FI.derived(store["memories"], VERSION), historical, facts, q.select("query_id", F.explode("a.names").alias("name")))


def _rate(df: DataFrame, hit: str, name: str) -> DataFrame:
    return df.agg(F.round(F.coalesce(F.avg(F.expr(hit).cast("double")), F.lit(1.0)), 6).alias("value")).select(F.lit(name).alias("metric"), "value")


def quality(spark: SparkSession, provider: Provider | None = None, width: int = R.DIM) -> DataFrame:
    """(metric, value): the thirteen figures over all timelines and sentences."""
    f = _frames(spark)
    p = provider or hashed_words(width)
    store = told(f["statements"], p, width)
    chosen = materialize(selected(f["questions"], store, p, width).select("query_id", F.col("content").alias("item"), F.col("final_rank")))
    place = F.row_number().over(V.by_query("final_rank"))
    chosen = chosen.withColumn("rank", place).drop("final_rank")
    # a question without any selected memory counts with nothing found
    asked = f["questions"].select("query_id")
    out = []
    at_1, at_k = (V.averages(V.ranking_metrics(chosen, f["relevant"], k, asked)) for k in (1, K))
    out.append(at_1.select(F.lit("precision_at_1").alias("metric"), F.col("precision").alias("value")))
    out += [at_k.select(F.lit(name).alias("metric"), F.col(c).alias("value")) for name, c in ((f"recall_at_{K}", "recall"), ("mrr", "mrr"), (f"ndcg_at_{K}", "ndcg"))]
    bad = asked.join(chosen.join(f["forbidden"], ["query_id", "item"]).select("query_id", F.lit(True).alias("bad")).distinct(), "query_id", "left")
    out.append(_rate(bad, "coalesce(bad, false)", "forbidden_selection_rate"))
    m = store["memories"].select("tenant", F.col("id"), F.concat_ws("|", "tenant", "content").alias("text"), "contradicted_by_id", "is_contradicted")
    end = lambda c: m.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text"))
    sup = store["links"].where("relationship_type = 'superseded_by'").join(end("source_memory_id"), "source_memory_id").join(end("target_memory_id"), "target_memory_id")
    sup = sup.select(F.col("source_memory_id_text").alias("a"), F.col("target_memory_id_text").alias("b"))
    con = m.where("is_contradicted").select(F.col("text").alias("a"), "contradicted_by_id").join(end("contradicted_by_id"), "contradicted_by_id", "left").select("a", F.col("contradicted_by_id_text").alias("b"))
    for name, kind, got in (("supersession", "superseded_by", sup), ("contradiction", "contradicted", con)):
        r = V.pair_precision_recall(got, f["pairs"].where(F.col("kind") == kind))
        out += [r.select(F.lit(f"{name}_{c}").alias("metric"), F.col(c).alias("value")) for c in ("precision", "recall")]
    e = f["edges"].join(store["edges"].select("tenant", "source", "relationship", "target").distinct().withColumn("got", F.lit(True)), ["tenant", "source", "relationship", "target"], "left")
    out.append(_rate(e, "coalesce(got, false) = present", "graph_edge_accuracy"))
    live = FI.derived(store["memories"].where("state <> 'archived'"), VERSION).groupBy("tenant", "entity_key", "attribute_key", "value_key").agg(F.count(F.lit(1)).alias("n"))
    one = f["facts"].join(live, ["tenant", "entity_key", "attribute_key", "value_key"], "left")
    out.append(_rate(one, "coalesce(n, 0) = 1", "duplicate_suppression_accuracy"))
    s = f["sentences"].withColumn("f", extraction.facts(F.col("text")))
    out.append(_rate(s, "coalesce(f.entity = entity AND f.attribute = attribute AND f.value = value, false)", "fact_extraction_accuracy"))
    out.append(_rate(s, "coalesce(f.temporal_state = temporal_state, false)", "temporal_classification_accuracy"))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


def labelled_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality(spark)


QUERIES = {"labelled_quality": labelled_quality}
SQL = {"labelled_quality": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in QUALITY.items()) + ") AS t(metric, value)"}
