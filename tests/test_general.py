"""Hierarchies, histories and the chunked helpers against plain restatements."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import hierarchy as H
from tessera.operators import history as V
from tessera import scale

LINKS = "id bigint, source_memory_id bigint, target_memory_id bigint, relationship_type string, path string"
FACTS = "memory_id bigint, tenant string, entity_key string, attribute_key string, value_text string, single_valued boolean, temporal_state string, is_negated boolean, is_placeholder boolean, updated_at timestamp, prev string"


def brute_tree(rows):
    up = {}
    for s, t in rows:
        up[s] = min(t, up.get(s, t))
    out = {}
    for n in {*up, *up.values()}:
        path, at = [n], n
        while at in up and up[at] not in path:
            at = up[at]
            path.append(at)
        out[n] = (-1, -1, "") if at in up else (at, len(path) - 1, "/".join(map(str, reversed(path))))
    return out


@pytest.mark.parametrize("walk", [5_000, 3])
def test_hierarchies(spark, walk):
    rng = random.Random(walk)
    edges = [(i, rng.randrange(i)) for i in range(1, 60) if rng.random() < 0.8] + [(100, 101), (101, 102), (102, 100), (103, 102), (104, 103), (110, 110), (111, 110), (7, 7)]
    spell = ["merged_into", " Merged-Into", "MERGED INTO", "merged_into "]
    rows = [(i, s, t, rng.choice(spell), "x") for i, (s, t) in enumerate(edges)]
    rows += [(900, 5, None, "merged_into", "x"), (901, None, 5, "merged_into", "x"), (902, 1, 2, "supports", "x"), (903, 1, 2, None, "x"), (904, *edges[0], "merged_into", "y")]
    got = H.hierarchies(spark.createDataFrame(rows, LINKS), walk_nodes=walk).collect()
    assert {r.memory_id: (r.root_id, r.depth, r.path) for r in got} == brute_tree(edges)
    assert len(got) == len(brute_tree(edges))
    if walk > 100:
        assert {r.memory_id: tuple(r.cycle) for r in got if r.cycle} == {**{i: (100, 101, 102) for i in (100, 101, 102)}, 110: (110,), 7: (7,)}


def test_both_paths_give_equal_rows_with_circles(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (6, 5), (7, 6), (10, 11), (11, 10), (12, 11), (20, 20), (21, 20), (30, 31), (32, 31), (30, 39)]
    df = spark.createDataFrame([(i, s, t, "merged_into", "") for i, (s, t) in enumerate(edges)], LINKS)
    rows = lambda walk: {r.memory_id: (r.root_id, r.depth, r.path, r.cycle) for r in H.hierarchies(df, walk_nodes=walk).collect()}
    walked, doubled = rows(5_000), rows(0)
    assert walked == doubled and set(walked) == {x for e in edges for x in e}
    assert doubled[3][3] == [1, 2, 3, 4, 5] and doubled[10][3] == [10, 11] and doubled[20][3] == [20] and doubled[7][3] is None
    assert doubled[39] == (39, 0, "39", None)


def test_hierarchies_of_nothing(spark):
    assert H.hierarchies(spark.createDataFrame([], LINKS)).count() == 0
    assert H.descendants(H.hierarchies(spark.createDataFrame([(1, None, None, None, None)], LINKS))).count() == 0


def test_descendants(spark):
    rows = [(1, 2, 1, "merged_into", ""), (2, 3, 2, "merged_into", ""), (3, 4, 1, "merged_into", "")]
    got = {(r.memory_id, r.descendant_id, r.distance) for r in H.descendants(H.hierarchies(spark.createDataFrame(rows, LINKS))).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 1)}


def test_deep_chain_in_components_of_any_size(spark):
    rows = [(i, i, i - 1, "merged_into", "") for i in range(1, 300)]
    got = H.hierarchies(spark.createDataFrame(rows, LINKS), walk_nodes=10).agg(F.max("depth"), F.countDistinct("root_id"), F.count("*")).first()
    assert tuple(got) == (299, 1, 300)


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    got = {r.node: r.component for r in H.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    group = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert got == group


def brute_versions(rows):
    """rows: (memory_id, tenant, entity, attribute, value, single, state, negated, placeholder, at)."""
    import re

    seen, keep = set(), []
    for r in sorted((r for r in rows if r[5] and not r[8] and r[0] is not None and r[9] is not None), key=lambda r: (r[9], r[0])):
        if r[0] not in seen:
            seen.add(r[0])
            keep.append(r)
    state, out = {}, {}
    for r in keep:
        if r[4] is None:
            continue
        k, v = r[1:4], re.sub(r"\s+", "", re.sub(r"[\s.,;:!]+$", "", r[4].lower()))
        now = state.get(k)
        if not r[7] and r[6] == "CURRENT":
            if now and now[0] == v:
                continue
            if now:
                out[now[1]] = r[0]
            state[k] = (v, r[0])
            out[r[0]] = -1
        elif r[7] and now and now[0] == v:
            out[now[1]] = r[0]
            state[k] = None
    return out


def test_versions(spark):
    rng = random.Random(9)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        hot = rng.random() < 0.4
        key = ("t", "user", "residence") if hot else (rng.choice(["t", None]), f"e{rng.randrange(30)}", rng.choice(["name", "age"]))
        value = rng.choice(["Pune", "pune.", " Pune ", "Mumbai", "New York", "new  york!", None])
        rows.append((i, *key, value, rng.random() < 0.9, rng.choice(["CURRENT", "CURRENT", "HISTORICAL", None, "FUTURE"]), rng.choice([False, False, True, None]), rng.random() < 0.1, t0 + timedelta(seconds=rng.randrange(900))))
    rows += [r[:9] + (r[9] + timedelta(days=1),) for r in rows[:50]] + rows[50:80]
    rows += [(None, "t", "user", "residence", "Oslo", True, "CURRENT", False, False, t0), (9999, "t", "user", "residence", "Oslo", True, "CURRENT", False, False, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], FACTS)
    got = {r.opened_by: r.closed_by for r in V.versions(df).collect()}
    assert got == brute_versions([(r[0], r[1], r[2], r[3], r[4], r[5], r[6], bool(r[7]), r[8], r[9]) for r in rows])


def test_versions_of_nothing_and_as_of(spark):
    empty = spark.createDataFrame([], FACTS)
    assert V.versions(empty).count() == 0
    t = datetime(2024, 1, 1)
    rows = [(1, "t", "u", "a", "x", True, "CURRENT", False, False, t, ""), (2, "t", "u", "a", "y", True, "CURRENT", False, False, t + timedelta(days=2), "")]
    h = V.versions(spark.createDataFrame(rows, FACTS))
    assert [r.opened_by for r in V.as_of(h, "2024-01-02").collect()] == [1]
    assert [r.opened_by for r in V.as_of(h, "2024-01-04").collect()] == [2]


def test_prefix_sums_over_a_hot_key(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, "hot").when(F.col("id") < 900, F.lit(None)).otherwise("c")).withColumn("v", F.col("id") % 7)
    out = scale.prefix_sums(df, ["k"], ["id"], {"s": F.col("v"), "n": F.lit(1)}).toPandas()
    for _, g in out.groupby("k", dropna=False):
        g = g.sort_values("id")
        assert (g.v.cumsum() == g.s).all() and list(g.n) == list(range(1, len(g) + 1))


def test_no_own_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://x"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        scale.shared_dir(type("S", (), {"sparkContext": Context}))


def feed(rng, n, start=0):
    rows = []
    for i in range(n):
        a = rng.choice(["home", "job", "job", "mood", "mood", "mood"])
        v = rng.choice(["x", "X ", "y", "z"]) if a == "mood" else rng.choice(["x", "x", "x", "y"])
        at = datetime(2024, 1, 1) + timedelta(minutes=start + i)
        rows.append((start + i, rng.choice(["t", "t", "u", None]), rng.choice("ab"), a, v, True, "CURRENT" if rng.random() < 0.9 else "HISTORICAL", rng.random() < 0.15, False, at, "p"))
    return rows


def test_a_batch_is_appended_as_if_the_feed_were_one(spark):
    rng = random.Random(4)
    parts = [feed(rng, n, s) for s, n in ((0, 200), (200, 1), (201, 150), (351, 60))]
    cols = [*V.KEYS, "memory_id", "updated_at", "value_text", "negated", "diff"]
    df = lambda rows: spark.createDataFrame(rows, FACTS)
    log = scale.materialize(V.satellite_log(df(parts[0])).select(cols))
    for p in parts[1:]:
        log = scale.materialize(log.unionByName(V.appended(log, df(p)).select(cols)))
    want = V.satellite_log(df([r for p in parts for r in p])).select(cols)
    assert sorted(map(tuple, log.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and log.count() > 100
    assert V.appended(log, df(parts[0]).where("false")).count() == 0


def test_attributes_are_split_by_change_rate(spark):
    rows = feed(random.Random(5), 400)
    s = V.satellites(spark.createDataFrame(rows, FACTS))
    names = {n: {r.attribute_key for r in d.select("attribute_key").distinct().collect()} for n, d in s.items()}
    assert names["slow"] and names["fast"] and not names["slow"] & names["fast"] and "mood" in names["fast"]
    v = V.versions(spark.createDataFrame(rows, FACTS))
    assert v.count() == sum(d.where("diff IS NOT NULL").count() for d in s.values())
    assert {(r.attribute_key, r.satellite) for r in v.select("attribute_key", "satellite").distinct().collect()} == {(a, n) for n, x in names.items() for a in x}


def test_links_to_other_parents_are_told(spark):
    rows = [(1, 5, 2, "merged_into", ""), (2, 5, 3, "Merged Into", ""), (3, 5, 3, "merged_into", ""), (4, 6, 5, "merged_into", ""), (5, None, 3, "merged_into", ""), (6, 5, 9, "x", "")]
    assert [tuple(r) for r in H.other_parents(spark.createDataFrame(rows, LINKS)).collect()] == [("merged_into", 5, 3)]


def test_discarded_tables_are_gone(spark):
    import os

    d = scale.materialize(spark.range(3))
    path = d._written.removeprefix("file:")
    assert os.path.isdir(path)
    scale.discard(d, spark.range(1))
    assert not os.path.isdir(path)
