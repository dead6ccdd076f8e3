"""Snapshots, administrative changes and checks."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import maintenance as A
from tessera.operators import memories as M
from tessera.sources.snapshots import Conflict, Snapshots

MEM = "id bigint, tenant string, content string, category string, importance double, embedding array<float>, access_count int, state string, version int, contradicted_by_id bigint, is_contradicted boolean"


def rows(spark):
    return spark.createDataFrame([(1, "t", "a", "fact", 0.1, [1.0], 0, "active", 1, None, False), (2, "t", "b", None, None, None, None, "archived", 1, 1, True), (3, "t", None, "fact", 0.9, [], 5, None, 1, None, None)], MEM)


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    with pytest.raises(LookupError):
        s.read()
    kv = lambda *r: spark.createDataFrame(list(r), "memory_id bigint, v string")
    assert s.append(kv((1, "a"))) == 1 and s.append(kv((2, "b"))) == 2
    assert s.insert(kv((2, "x"), (3, "c"), (3, "c")), ["memory_id"]) == 3
    s.upsert(kv((1, "A")), gone=kv((2, "")))
    assert sorted(map(tuple, s.read().collect())) == [(1, "A"), (3, "c")]
    assert sorted(map(tuple, s.read(2).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Conflict):
        s.replace(kv((9, "z")), expected=2)
    assert s.version() == 4


def test_corrections(spark):
    c = spark.createDataFrame([(1, "new", 1, [0.5]), (2, "late", 7, None), (9, "none", None, None)], "id bigint, content string, expected_version int, embedding array<float>")
    m, e = A.corrected(rows(spark), c, "2024-01-01")
    got = {r.id: (r.content, r.version) for r in m.collect()}
    assert got == {1: ("new", 2), 2: ("b", 1), 3: (None, 1)}
    assert [(r.memory_id, r.raw_text, r.previous_text) for r in e.collect()] == [(1, "new", "a")]


def test_archive_is_idempotent(spark):
    ids = spark.createDataFrame([(1,), (1,), (2,), (8,)], "id bigint")
    m, e = A.archived(rows(spark), ids, "2024-01-01")
    assert {r.id: (r.state, r.version) for r in m.collect()} == {1: ("archived", 2), 2: ("archived", 1), 3: (None, 1)} and e.count() == 1
    again, e2 = A.archived(m, ids, "2024-01-02")
    assert e2.count() == 0 and again.count() == 3


def test_purge_removes_what_hangs_on_it(spark):
    t = {
        "memories": rows(spark),
        "memory_relationships": spark.createDataFrame([(1, 1, 2, "x"), (2, 2, 3, "x"), (3, 3, None, "x")], "id bigint, source_memory_id bigint, target_memory_id bigint, relationship_type string"),
        "memory_entities": spark.createDataFrame([(1, 10, "subject"), (2, 11, "subject"), (2, 10, None)], "memory_id bigint, entity_id bigint, role string"),
        "entities": spark.createDataFrame([(10, "x"), (11, "y"), (12, "z")], "id bigint, normalized_name string"),
        "entity_aliases": spark.createDataFrame([(1, 10), (2, 11)], "id bigint, entity_id bigint"),
    }
    out = A.purged(t, spark.createDataFrame([(1,)], "id bigint"))
    assert {r.id: r.contradicted_by_id for r in out["memories"].collect()} == {2: None, 3: None}
    assert {r.id for r in out["memory_relationships"].collect()} == {2, 3}
    # an entity that nothing needs goes, an aliased one or one with an edge stays though no memory is left
    assert {r.id for r in out["entities"].collect()} == {10, 11} and out["memory_entities"].count() == 2
    gone = A.purged(t, spark.createDataFrame([(2,)], "id bigint"), edges=spark.createDataFrame([(12, 10, 3), (11, 12, 2)], "source_id bigint, target_id bigint, memory_id bigint"))
    assert {r.id for r in gone["entities"].collect()} == {10, 11, 12} and {r.id for r in gone["entity_aliases"].collect()} == {1, 2}
    assert [tuple(r) for r in gone["edges"].collect()] == [(12, 10, 3)]
    assert A.deleted({"memories": rows(spark)}, spark.createDataFrame([(1,)], "id bigint"), "2024-01-01")["memories"].where("state = 'archived'").count() == 2
    assert A.deleted({"memories": rows(spark)}, spark.createDataFrame([(1,)], "id bigint"), "2024-01-01", purge=True)["memories"].count() == 2


def test_purge_tells_what_was_lost(spark):
    t = {"memories": rows(spark), "memory_relationships": spark.createDataFrame([(1, 1, 2, "Superseded By"), (2, 3, 1, "merged_into"), (3, 2, 3, "x")], "id bigint, source_memory_id bigint, target_memory_id bigint, relationship_type string")}
    out = A.purged(t, spark.createDataFrame([(1,)], "id bigint"))
    assert {r.memory_id: list(r.reason_codes) for r in out["evidence"].collect()} == {2: ["purged_memory:1", "contradicted_by:outgoing", "superseded_by:incoming"], 3: ["purged_memory:1", "merged_into:outgoing"]}
    assert {r.id: r.version for r in out["memories"].collect()} == {2: 2, 3: 2}


def test_graph_walks_and_aliases(spark):
    from tessera.operators import graph as G

    e = spark.createDataFrame([("user", "rahul"), ("rahul", "google"), ("a", "b"), ("google", "user")], "source string, target string")
    s = spark.createDataFrame([("user",), ("b",), ("nobody",), (None,)], "name string")
    assert {(r.start, r.name, r.hops) for r in G.expanded(e, s).collect()} == {("user", "user", 0), ("user", "rahul", 1), ("user", "google", 1), ("b", "b", 0), ("b", "a", 1), ("nobody", "nobody", 0)}
    assert {(r.start, r.name) for r in G.neighbours(e, s).collect()} == {("user", "rahul"), ("user", "google"), ("b", "a")}
    a = spark.createDataFrame([(1, "bob")], "entity_id bigint, alias_normalized string")
    new = spark.createDataFrame([(2, "The Bob!"), (3, "  "), (4, "Rob"), (5, "rob")], "entity_id bigint, alias string")
    assert {tuple(r) for r in G.with_aliases(a, new).collect()} == {(1, "bob"), (4, "rob")}
    n, m = G.merged(spark.createDataFrame([("Rahul", "PERSON", 1), ("rahul", "PERSON", 2)], "name string, type string, memory_id bigint"), spark.createDataFrame([("Rahul", "X", "Works_At"), ("rahul", "x", "works_at")], "source string, target string, relationship string"))
    assert [tuple(r) for r in n.collect()] == [("rahul", "PERSON", 2)] and m.count() == 1


def test_validation(spark):
    A.validate(rows(spark), 1)
    with pytest.raises(ValueError):
        A.validate(rows(spark), 384)
    with pytest.raises(ValueError):
        A.validate(rows(spark).drop("tenant"), 1)
    with pytest.raises(LookupError):
        M.by_id(rows(spark), 77)
    with pytest.raises(ValueError):
        M.check_version(rows(spark), 1, 5)
    M.check_version(rows(spark), 1, 1)


def test_backfill_and_access(spark):
    got = M.backfill_embeddings(rows(spark), F.array(F.lit(2.0).cast("float"))).collect()
    assert {r.id: list(r.embedding) for r in got} == {1: [1.0], 2: [2.0], 3: []}
    assert M.missing_embeddings(rows(spark)).count() == 1
    seen = {r.id: (r.access_count, r.state) for r in M.listing(rows(spark), record_access=True).collect()}
    assert seen == {1: (1, "weak")}
    assert A.report_json(rows(spark).select("id")).first()[0] == '{"id":1}'


def test_append_reads_nothing_and_conflicts_are_told(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    kv = lambda *r: spark.createDataFrame(list(r), "memory_id bigint, v string")
    s.append(kv((1, "a")))
    first = s.parts(1)
    s.append(kv((2, "b")))
    assert s.parts(2)[: len(first)] == first and len(s.parts(2)) == 2 and s.read().count() == 2
    late = Snapshots(spark, f"file://{tmp_path}/t")
    late.version = lambda: 1  # a writer that has not seen the second version
    with pytest.raises(Conflict):
        late.append(kv((3, "c")))
    assert s.version() == 2 and s.read().count() == 2


def test_settings_names_and_calibration(spark):
    from tessera import settings
    from tessera.functions import embedding, scoring

    got = settings.load({"CONTEXT_RETRIEVAL_LIMIT": "7", "WAREHOUSE": "/w", "CONTEXT_TOKEN_BUDGET": " "})
    assert (got.context_retrieval_limit, got.warehouse, got.context_token_budget) == (7, "/w", 1200)
    for bad in ({"CONTEXT_RETRIEVAL_LIMIT": "x"}, {"STRUCTURAL_CANDIDATE_LIMIT": "-1"}):
        with pytest.raises(ValueError):
            settings.load(bad)
    names = spark.createDataFrame([("duplicate",), ("contradiction",), ("?",)], "r string").select(scoring.mapped(F.col("r"), scoring.RELATION_ACTIONS))
    assert [r[0] for r in names.collect()] == ["merge", "contradict", None]
    pairs = spark.createDataFrame([("I like tea", "tea I like", "duplicate"), ("I like tea", "Dark mode", "different"), (None, "x", "none")], "first string, second string, label string")
    c = {r.label: r.similarity for r in embedding.calibration(pairs, embedding.hashed_words(64), 64).collect()}
    assert c["duplicate"] > 0.999 and c["different"] < 0.5 and c["none"] is None
    with pytest.raises(Exception, match="wide"):
        pairs.select(embedding.embedded(F.col("second"), embedding.hashed_words(8), 64)).collect()
