"""Golden values of the text functions and metrics."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as X
from tessera.operators import context as C
from tessera.operators import evaluation as E
from tessera.operators import graph as G
from tessera.operators import lineage as L


@pytest.mark.parametrize(
    ("content", "query", "score"),
    [
        ("I drive a car.", "car", 1.0),
        ("I own two cars.", "car", 1.0),
        ("My career is long.", "car", 0.0),
        ("A scary film", "car", 0.0),
        ("We carpool daily", "car", 0.0),
        ("I live in Pune.", "live Pune", 1.0),
        ("I live in Mumbai.", "live Pune", 0.075),
        ("", "car", 0.0),
        (None, "car", 0.0),
        ("a b", "", 0.0),
    ],
)
def test_lexical_score(spark, content, query, score):
    df = spark.createDataFrame([(content, query)], "c string, q string")
    q = F.col("q")
    assert df.select(X.lexical_score(X.tokens(F.col("c")), X.tokens(q), X.query_terms(q))).first()[0] == pytest.approx(score)


@pytest.mark.parametrize(("text", "cues", "hit"), [("William came", X.FUTURE_CUES, False), ("I will go", X.FUTURE_CUES, True), ("Washington", X.PAST_CUES, False), ("it was removed", X.TRANSITION_CUES, False), ("I MOVED to Pune", X.TRANSITION_CUES, True), (None, X.PAST_CUES, False)])
def test_cues(spark, text, cues, hit):
    assert spark.createDataFrame([(text,)], "t string").select(X.has_cue(F.col("t"), cues)).first()[0] is hit


@pytest.mark.parametrize(("text", "name"), [("My MacBook Air", "macbook air"), ("Rahul Patel", "rahul patel"), (" the  city's ", "city"), ("...", ""), (None, ""), ("the", "")])
def test_entity_name(spark, text, name):
    assert spark.createDataFrame([(text,)], "t string").select(X.entity_name(F.col("t"))).first()[0] == name


@pytest.mark.parametrize(("query", "intent"), [("What city do I live in?", "CURRENT"), ("Where did I live before?", "HISTORICAL"), ("Where am I planning to move?", "FUTURE")])
def test_temporal_intent(spark, query, intent):
    assert spark.createDataFrame([(query,)], "t string").select(X.temporal_intent(F.col("t"))).first()[0] == intent


def test_cosine_of_useless_vectors_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(S.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, None, None]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abc")], "query_id string, item string, rank int")
    rel = lambda *xs: spark.createDataFrame([("q", x) for x in xs], "query_id string, item string")
    one = lambda r, k: E.ranking_metrics(ranked, r, k).first()
    assert one(rel("b"), 1).precision == 0
    assert one(rel("a", "c"), 2).precision == 0.5
    assert one(rel("a", "z"), 3).recall == 0.5
    assert one(rel("c"), 3).reciprocal_rank == pytest.approx(1 / 3)
    assert one(rel("z"), 3).reciprocal_rank == 0
    assert one(rel("a"), 3).ndcg == 1
    assert one(rel("b"), 3).ndcg == pytest.approx(0.6309, abs=1e-4)
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert tuple(E.pair_precision_recall(none, none).first()) == (0, 1.0, 1.0)


def test_longest_spans_win(spark):
    e = spark.createDataFrame([(1, "rahul"), (2, "rahul sharma"), (3, "pune"), (4, "user")], "id bigint, normalized_name string")
    a = spark.createDataFrame([(3, "poona"), (1, "rahul sharma")], "entity_id bigint, alias_normalized string")
    t = spark.createDataFrame([(1, "Where does Rahul Sharma work?"), (2, "rahul in poona with the user"), (3, None), (4, "")], "id bigint, text string")
    got = {(r.id, r.entity_id) for r in G.entities_in(t, "id", "text", e, a).collect()}
    assert got == {(1, 2), (2, 1), (2, 3)}


def test_insert_new_skips_conflicts(spark):
    have = spark.createDataFrame([(1, "a")], "k bigint, v string")
    more = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k bigint, v string")
    assert [tuple(r) for r in L.insert_new(have, more, ["k"]).collect()] == [(2, "c")]


def test_diversity_and_budget(spark):
    rows = [("q", 1, 1, "I live in Pune", "user", "residence", "pune"), ("q", 2, 2, "i live in pune ", "user", "residence", "pune"), ("q", 3, 3, "I live in Mumbai", "user", "residence", "mumbai"), ("q", 4, 4, "I live in Pune now", None, None, None), ("q", 5, 5, "Coffee is good", None, None, None)]
    df = spark.createDataFrame(rows, "query_id string, memory_id bigint, final_rank int, content string, entity_key string, attribute_key string, value_key string")
    kept = C.diversified(df)
    assert sorted(r.memory_id for r in kept.collect()) == [1, 3, 5]
    assert sorted(r.memory_id for r in C.within_budget(kept, 30).collect()) == [1, 3]
