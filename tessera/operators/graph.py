"""Entities, their aliases and links to memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.operators.hierarchy import connected_components
from tessera.scale import materialize

MAX_SPAN = 5
USER = "user"
def names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, entity_id): names and, where no entity has the name itself, aliases; the least id wins."""
    n = entities.where("normalized_name IS NOT NULL").groupBy(F.col("normalized_name").alias("name")).agg(F.min("id").alias("entity_id"))
    a = aliases.where("alias_normalized IS NOT NULL").groupBy(F.col("alias_normalized").alias("name")).agg(F.min("entity_id").alias("entity_id"))
    return n.unionByName(a.join(n.select("name"), "name", "left_anti"))


def resolve(mentions: DataFrame, text_col: str, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``mentions`` with entity_id: by the normalized name, else by alias, else null."""
    key = X.entity_name(F.col(text_col))
    return mentions.withColumn("name", key).join(names(entities, aliases), "name", "left").drop("name")


def spans(texts: DataFrame, id_col: str, text_col: str, starts: DataFrame | None = None) -> DataFrame:
    """(id, words, start, name): every run of up to five words, of those that begin with a word of ``starts`` (word) if given."""
    w = texts.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    w = w.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice("w", i, F.lit(MAX_SPAN)))).alias("start", "run")).withColumn("word", F.col("run")[0])
    if starts is not None:
        w = w.join(starts, "word", "left_semi")
    n = w.select("id", "start", "run", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("words"))
    return n.select("id", "words", "start", F.array_join(F.slice("run", F.lit(1), F.col("words")), " ").alias("name"))


def entities_in(texts: DataFrame, id_col: str, text_col: str, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, entity_id, start): entities that the text names, longest runs first, none inside another.

    Of equal length the earlier run wins. The texts' candidates are few (their runs that are names), so
    the choice is a fold over one short array.
    """
    known = names(entities, aliases).where(F.col("name") != USER)
    # a run is only built where a name's first word stands, and runs that are no name go before anything is grouped
    starts = known.select(F.split("name", " ")[0].alias("word")).distinct()
    hit = spans(texts, id_col, text_col, starts).join(known, "name")
    hit = hit.groupBy("id", "name", "entity_id").agg(F.min("start").alias("start"), F.first("words").alias("words"))
    per = hit.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("words")).alias("order"), "start", "words", "entity_id"))).alias("s"))
    kind = "array<struct<order:int,start:int,words:int,entity_id:bigint>>"
    apart = lambda p, s: (p["start"] + p["words"] <= s["start"]) | (s["start"] + s["words"] <= p["start"])
    fold = F.aggregate("s", F.array().cast(kind), lambda acc, s: F.when(F.forall(acc, lambda p: apart(p, s)), F.concat(acc, F.array(s).cast(kind))).otherwise(acc))
    e = per.select("id", F.explode(fold).alias("e"))
    return e.groupBy("id", F.col("e.entity_id").alias("entity_id")).agg(F.min("e.start").alias("start"))


def entity_memories(memory_entities: DataFrame) -> DataFrame:
    """(memory_id, entity_id, role): one row for each link; subject before value before mention."""
    order = F.when(F.col("role") == "subject", 0).when(F.col("role") == "value", 1).when(F.col("role") == "mention", 2).otherwise(3)
    g = memory_entities.where("memory_id IS NOT NULL AND entity_id IS NOT NULL").groupBy("memory_id", "entity_id").agg(F.min_by("role", order).alias("role"))
    return g


def memories_of(found: DataFrame, memory_entities: DataFrame) -> DataFrame:
    """(id, memory_id): memories linked to the entities found in each text, each once."""
    links = memory_entities.select("entity_id", "memory_id").distinct()
    return found.select("id", "entity_id").join(links, "entity_id").select("id", "memory_id").distinct()


def orphans(entities: DataFrame, memory_entities: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id): entities with no memory, no alias and no edge (source_id, target_id) to or from them."""
    e = entities.select("id")
    e = e.join(memory_entities.select(F.col("entity_id").alias("id")), "id", "left_anti")
    e = e.join(aliases.select(F.col("entity_id").alias("id")), "id", "left_anti")
    return e.join(edges.select(F.explode(F.array("source_id", "target_id")).alias("id")), "id", "left_anti")


def with_aliases(aliases: DataFrame, added: DataFrame) -> DataFrame:
    """``aliases`` with (entity_id, alias) as typed: each normalized name once, known ones and empty ones change nothing."""
    new = added.select("entity_id", X.entity_name(F.col("alias")).alias("alias_normalized")).where("alias_normalized <> '' AND entity_id IS NOT NULL")
    new = new.groupBy("alias_normalized").agg(F.min("entity_id").alias("entity_id")).join(aliases.select("alias_normalized"), "alias_normalized", "left_anti")
    return aliases.select("entity_id", "alias_normalized").unionByName(new)


def unlinked(frame: DataFrame, ids: DataFrame) -> DataFrame:
    """Links or edges (any frame with memory_id) without those that the memories in ``ids`` (id) support."""
    return frame.join(ids.select(F.col("id").alias("memory_id")), "memory_id", "left_anti").select(*frame.columns)


def degrees(memory_entities: DataFrame) -> DataFrame:
    """(entity_id, memories): memories of each entity, counted and not collected."""
    return entity_memories(memory_entities).groupBy("entity_id").agg(F.count(F.lit(1)).alias("memories"))


def stated_edges(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship, memory_id): edges between entities, a row for each memory that states one.

    The relation is the attribute; a value counts where it is an entity's name.
    """
    e = entities.select("id", "normalized_name")
    f = facts.where("NOT coalesce(is_placeholder, false)").select("entity_key", F.lower(F.trim("value_key")).alias("value"), "attribute_key", "memory_id").distinct()
    s = e.select(F.col("id").alias("source_id"), F.col("normalized_name").alias("entity_key"))
    t = e.select(F.col("id").alias("target_id"), F.col("normalized_name").alias("value"))
    return f.join(s, "entity_key").join(t, "value").where("source_id <> target_id").select("source_id", "target_id", F.col("attribute_key").alias("relationship"), "memory_id").distinct()


def typed_edges(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship): distinct edges between entities that facts state."""
    return stated_edges(facts, entities).select("source_id", "target_id", "relationship").distinct()


def closure(memory_entities: DataFrame) -> DataFrame:
    """(entity_id, component): entities reachable from each other over shared memories.

    Memories tie their entities in a star around the least entity id, not in all pairs.
    """
    links = entity_memories(memory_entities).select("memory_id", "entity_id")
    hub = links.groupBy("memory_id").agg(F.min("entity_id").alias("hub"))
    edges = links.join(hub, "memory_id").select(F.col("hub").alias("a"), F.col("entity_id").alias("b")).distinct()
    return connected_components(edges, "a", "b").select(F.col("node").alias("entity_id"), "component")


def neighbours(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, name): what an edge (source, target) ties to each name of ``start`` (name), in either direction."""
    s = start.select(F.col("name").alias("start")).distinct()
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return s.join(both.withColumnsRenamed({"source": "start", "target": "name"}), "start")


def expanded(edges: DataFrame, start: DataFrame, max_hops: int = 64) -> DataFrame:
    """(start, name, hops): every name that each start reaches over edges in either direction, itself at 0.

    One join a hop over the names met last; stops when a hop meets no new name.
    """
    both = materialize(edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    last = seen = materialize(start.select(F.col("name").alias("start"), "name", F.lit(0).alias("hops")).where("name IS NOT NULL").distinct())
    for hop in range(1, max_hops + 1):
        step = last.join(both.withColumnRenamed("source", "name"), "name").select("start", F.col("target").alias("name")).distinct()
        last = materialize(step.join(seen.select("start", "name"), ["start", "name"], "left_anti").withColumn("hops", F.lit(hop)))
        if last.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(last)
    raise RuntimeError(f"names are more than {max_hops} hops apart")


def merged(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One node for each name whatever its case, with its memories counted, and each edge once."""
    n = nodes.withColumn("name", F.lower("name")).groupBy("name").agg(F.min("type").alias("type"), F.count_distinct("memory_id").alias("memories"))
    e = edges.select(F.lower("source").alias("source"), F.lower("target").alias("target"), F.lower("relationship").alias("relationship")).distinct()
    return n, e


def popular(memory_entities: DataFrame, k: int) -> DataFrame:
    """(entity_id, memories, rank): the k entities with most memories, ties by the lesser id."""
    top = degrees(memory_entities).orderBy(F.desc("memories"), "entity_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("memories"), "entity_id")))


def node_search(entities: DataFrame, memory_entities: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, entity_id, memory_id): memories of the entities whose name is exactly the keyword (null: none)."""
    k = keywords.select("keyword", X.entity_name(F.col("keyword")).alias("key")).where("key <> ''").distinct()
    named = entities.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct(F.array(X.entity_name(F.col("normalized_name")), X.entity_name(F.col("display_name"))))).alias("key"))
    links = memory_entities.select("entity_id", "memory_id").distinct()
    return k.join(named, "key").select("keyword", "entity_id").distinct().join(links, "entity_id", "left").select("keyword", "entity_id", "memory_id")
