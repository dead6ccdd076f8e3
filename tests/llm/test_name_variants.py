"""Name variants: rewritings, links, ambiguity, odd rows."""

import pytest

from tessera.llm import name_variants as N

SCHEMA = "id bigint, normalized_name string, display_name string, entity_type string, entity string"
FORMS = [("Elizabeth", "Betty"), ("Alexander", "Alex"), ("Alexandra", "Alex"), ("Andrew", "Andy")]


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abc", "abd", 1), ("abc", "ab", 1), ("abc", "acb", 1), ("abc", "cab", None), ("", "a", 1), ("abcd", "abdce", None)])
def test_one_edit(a, b, d):
    assert N.one_edit(a, b) == d and N.one_edit(b, a) == d
    if d is not None:
        assert N.deletions(a) & N.deletions(b)


def linked(spark, rows, aliases=None):
    e = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    f = spark.createDataFrame(FORMS, "given_name string, short_form string")
    return {(r.a, r.b) for r in N.variant_pairs(N.name_variants(e, f, aliases)).collect()}


def test_people(spark):
    rows = [
        (1, "elizabeth goafegarth", "Elizabeth Goafegârth", "PERSON"),
        (2, "goafegarth, prof. elizbeth", "Goafegarth, Prof. Elizbeth", "PERSON"),
        (3, "betty goafegarth (she/her", None, "PERSON"),
        (4, "e. goafegarth", "E. Goafegarth", "PERSON"),
        (5, "andrew goafegarth", "Andrew Goafegarth", "PERSON"),
        (6, "andy goafe garth", "Andy Goafe Garth", "PERSON"),
        (7, "elizabeth other", "Elizabeth Other", "PERSON"),
        (8, "elizabeth goafegarth", "x", "CONCEPT"),
        (9, None, None, "PERSON"),
        (10, "", " ", "PERSON"),
    ]
    assert linked(spark, rows) == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6)}


def test_ambiguous_forms_link_to_none(spark):
    rows = [(1, "alexander mond", "", "PERSON"), (2, "alexandra mond", "", "PERSON"), (3, "alex mond", "", "PERSON"), (4, "a. mond", "", "PERSON")]
    assert linked(spark, rows) == set()


def test_organisations(spark):
    rows = [(i, f"name{c}ford {t} {l}", None, "ORG") for i, (c, t, l) in enumerate([(c, t, l) for c in "klmn" for t, l in (("freight", "company"), ("brewing", "limited"))])]
    rows += [(50, "namekford frt co", "", "ORG"), (51, "freight company namekford", "", "ORG"), (52, "namekford freight", "", "ORG"), (53, "nameklford brewing ltd.", "", "ORG"), (54, "nameqford", "", "ORG")]
    got = linked(spark, rows)
    assert {(0, 50), (0, 51), (0, 52), (50, 51), (1, 53)} <= got
    assert (0, 1) not in got and all(54 not in p for p in got)


def test_aliases_and_empty_table(spark):
    al = spark.createDataFrame([(1, "pat qrstuv"), (None, "x"), (7, None)], "entity_id bigint, alias_normalized string")
    rows = [(1, "patricia zzwxyv", "", "PERSON"), (2, "pat qrstuv", "", "PERSON")]
    assert linked(spark, rows, al) == {(1, 2)}
    assert linked(spark, []) == set()


def test_slices_of_the_forms_hold_all_pairs_and_only_hashes(spark):
    names = ["goafegarth", "goafegart", "gaofegarth", "stemmond", "stemond", "lurida"]
    rows = [(i, "PERSON", "anna", s, "", False) for i, s in enumerate(names)]
    d = spark.createDataFrame(rows, "key bigint, kind string, a string, b string, c string, weak boolean")
    met = [N._met(d, k) for k in range(N.SLICES)]
    assert {t for m in met for _, t in m.dtypes} == {"bigint"}
    got = {(r.x, r.y) for m in met for r in m.collect()}
    assert {(i, j) for i in range(6) for j in range(i + 1, 6) if N.one_edit(names[i], names[j]) is not None} <= got
    assert sum(0 < m.count() for m in met) > 1
