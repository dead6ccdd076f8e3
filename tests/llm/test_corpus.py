"""Packing, mixing and subjects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M
from tessera.llm import packing as P
from tessera.llm import subjects as S
from tessera.llm import tokens as T

LENGTHS = "doc_id bigint, n_tokens bigint, container bigint"


def test_pack(spark):
    rng = np.random.default_rng(4)
    n = [int(x) for x in np.concatenate([rng.integers(1, 400, 500), np.full(300, 12), rng.integers(1500, 6000, 20), [2048, 4096, 0]])]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(n)], LENGTHS)
    p = P.pack(df).toPandas()
    by = p.groupby("container").n.sum()
    assert by.max() <= 2048 and p.n.sum() == sum(n) and len(by) <= np.ceil(sum(n) / 2048) + 1
    pieces = p.groupby("doc_id").n.agg(["size", "sum"])
    assert all(pieces["sum"][i] == x and pieces["size"][i] == -(-x // 2048) for i, x in enumerate(n) if x)
    assert P.report(P.pack(df)).first().used_share > 0.99
    assert P.pack(spark.createDataFrame([], LENGTHS)).count() == 0 and P.report(P.pack(df.where("doc_id < 0"))).first().containers == 0


def used_up(loads, capacity: int) -> tuple[np.ndarray, int]:
    used, fitted = np.zeros(capacity + 1, np.int64), 0
    for l in loads:
        assert sum(x * t for d in (l.fitted, l.later) for x, t in d.items()) == l.used <= capacity and l.times > 0
        for d in (l.fitted, l.later):
            for x, t in d.items():
                used[x] += t * l.times
        fitted += sum(l.fitted.values()) * l.times
    return used, fitted


def test_plan_uses_up_the_histogram():
    h = np.zeros(101, np.int64)
    h[[3, 50, 51, 99, 100]] = [7, 5, 1, 2, 3]
    assert (used_up(P.plan(h), 100)[0] == h).all()
    rng = np.random.default_rng(9)
    for capacity in (1, 2, 17, 300):
        for n in (1, 5, 200):
            h = np.bincount(rng.integers(1, capacity + 1, n), minlength=capacity + 1)
            assert (used_up(P.plan(h), capacity)[0] == h).all()
    assert P.plan(np.zeros(50, np.int64)) == []


@pytest.mark.parametrize("n", [1000, 10_000, 200_000])
def test_fitted_patterns_place_most_documents(n):
    """Lengths as in a corpus: many short ones, a long tail, some that fill a container."""
    length = np.minimum(np.random.default_rng(n).lognormal(3.6, 1.3, n).astype(int) + 4, 2048)
    h = np.bincount(length, minlength=2049)
    loads = P.plan(h)
    used, fitted = used_up(loads, 2048)
    assert (used == h).all() and fitted >= 0.8 * n
    least = -(-length.sum() // 2048)
    assert sum(l.times for l in loads) <= max(least + 1, 1.003 * least)


def test_fit_is_the_least_squares_solution():
    """No pattern could lessen the misfit, and those in use are at a stationary point."""
    rng = np.random.default_rng(3)
    patterns, h = rng.integers(0, 4, (60, 8)), rng.integers(1, 50, 8).astype(float)
    x = P.non_negative_fit(patterns, h, np.ones(8))
    gain = patterns @ (h - x @ patterns)
    assert x.min() >= 0 and (x > 0).sum() <= 8 and gain.max() < 1e-6 and np.abs(gain[x > 0]).max() < 1e-6


def test_mix(spark):
    rng = np.random.default_rng(6)
    rows = [(i, ["Big", " big", "BIG "][i % 3] if i < 6000 else "small_one" if i < 6500 else None if i < 6600 else "other", int(rng.integers(5, 300)), 1) for i in range(7000)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, copy int").drop("copy").withColumn("source", M.source_form(F.col("source")))
    targets = spark.createDataFrame([("big", 0.6, 1), ("Small-One", 0.4, 3), ("absent", 0.1, 2), (None, 0.1, 1), ("other", None, None)], "source string, target_share double, max_repeats int")
    rated = M.rates(sized, targets, exact=True)
    mixed = M.mix(sized, rated)
    s = {r.source: r for r in M.shares(mixed, rated).collect()}
    assert abs(s["big"].actual_share - 0.6) < 0.005 and s["small-one"].most_repeats == 3 and s["absent"].tokens == 0
    per = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).where("n <> m OR n > 3").count()
    assert per == 0 and {r.source for r in mixed.select("source").distinct().collect()} == {"big", "small-one"}
    small = M.rates(sized, targets, total_tokens=10_000_000)
    assert {r.source: r.rate for r in small.collect()}["small-one"] == 3.0
    assert M.mix(sized.limit(0), M.rates(sized.limit(0), targets)).count() == 0


def test_mix_of_the_corpus_size(spark):
    """A source that is too small gives all it may, the others fill up by their targets; rows follow the input."""
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 3), ("a", 0.5, 2)], "source string, target_share double, max_repeats int")
    taken = []
    for n in (1000, 10_000):
        rows = [(i, "a" if i % 20 < 12 else "b" if i % 20 < 19 else "c", 10 + i % 7) for i in range(n)]
        sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
        rated = M.rates(sized, targets)
        s = {r.source: r for r in M.shares(M.mix(sized, rated), rated).collect()}
        assert s["c"].rate == 3.0 and s["c"].most_repeats == 3 and abs(s["c"].actual_share - 0.15) < 0.01
        assert abs(s["a"].actual_share / s["b"].actual_share - 5 / 3) < 0.03 and abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
        assert abs(sum(r.tokens for r in s.values()) / sum(r[2] for r in rows) - 1) < 0.01 and len(s) == 3
        taken.append(M.mix(sized, rated).count())
    assert abs(taken[1] / taken[0] - 10) < 0.2
    assert {r.rate for r in M.rates(sized, targets, total_tokens=10**9).collect()} == {2.0, 3.0}


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "a"), (2, "", "b"), (3, None, "c"), (None, "x", "d"), (4, "word " * 20_000, "e")], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in T.with_tokens(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[4] >= 20_000 and set(got) == {1, 2, 4}


def corpus(rng, n):
    nouns = {"law": "judge court statute verdict", "food": "recipe butter onion soup", "sport": "goal coach stadium relay"}
    plain = ["It was a long day and nobody came.", "For now the letter is enough.", "Perhaps the {x} will be needed again."]
    docs, truth = [], {}
    for i in range(n):
        out, have = [], set()
        for _ in range(rng.integers(1, 5)):
            if rng.random() < 0.5:
                s = rng.choice(list(nouns))
                a, b = rng.choice(nouns[s].split(), 2, replace=False)
                out.append(f"First comes the {a}, then comes the {b}.")
                have.add(s)
            else:
                out.append(str(rng.choice(plain)).replace("{x}", str(rng.choice([w for v in nouns.values() for w in v.split()]))))
        docs.append((i, " ".join(out), "x"))
        truth[i] = have
    return docs, truth


def test_subjects(spark):
    docs, truth = corpus(np.random.default_rng(8), 900)
    labels = [(i, s.title(), r, None) for i in range(0, 900, 4) for s in (truth[i] or {"none"}) for r in "ab"] + [(0, "nonsense", "a", None), (None, "law", "a", None)]
    d = spark.createDataFrame([*docs, (None, "judge", "x"), (5000, None, "x"), (5001, "", "x")], "doc_id bigint, text string, subject string")
    l = spark.createDataFrame(labels, "doc_id bigint, subject string, rater string, votes string")
    a = spark.createDataFrame([("law", 0.3), ("food", 0.3), ("Sport ", 0.4), (None, 1.0)], "subject string, target_share double")
    got = S.document_subjects(d, l, a)
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    hit = sum(len(truth[i] & found.get(i, set())) for i in truth if i % 4)
    made, want = sum(len(v) for k, v in found.items() if k % 4), sum(len(truth[i]) for i in truth if i % 4)
    assert hit / made > 0.9 and hit / want > 0.9
    assert sum(r.documents for r in S.composition(got, d, a).collect()) == got.count()


def test_subjects_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    l = spark.createDataFrame([], "doc_id bigint, subject string, rater string")
    a = spark.createDataFrame([("law", 1.0)], "subject string, target_share double")
    assert S.document_subjects(d, l, a).count() == 0


@pytest.mark.parametrize("text", ["", "One. Two words! Three?", "a\nb", "...", "No end"])
def test_sentences_keep_all_words(text):
    assert [w for s in S.sentence_words(text) for w in s] == S._WORD.findall(text.lower())


def test_sentence_mixtures_settle():
    """The rounds in use come close to what many rounds give."""
    import numpy as np
    import pandas as pd

    from tessera.llm import subjects as S

    k, rng = 3 + S.BACKGROUND, np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    docs = pd.DataFrame({"doc_id": range(40), "votes": [None] * 40, "text": [". ".join(" ".join(rng.choice(words, 12)) for _ in range(4)) + "." for _ in range(40)]})
    phi = rng.gamma(0.2, 1, (1 << S.HASH_BITS, k)).astype(np.float32) + 1e-4
    x = S._Batch(next(S._encoded(iter([docs]))), k)
    used, inner = x.responsibilities(phi), S.INNER
    try:
        S.INNER = 100
        settled = x.responsibilities(phi)
    finally:
        S.INNER = inner
    assert np.abs(used - settled).mean() < 0.015


def test_topics_are_mapped_by_their_terms():
    """A topic that holds another subject's terms is mapped to that one, a topic of terms of all subjects to none."""
    n, k = 3, 3 + S.BACKGROUND
    counts = np.zeros((60, n + S.BACKGROUND), np.float32)
    for s in range(n):
        counts[10 * s : 10 * s + 10, s] = 9
    counts[30:60, :n] = 3
    counts[:, k - 2], counts[:, k - 1] = 10, 20
    phi = np.full((60, k), 1e-4)
    for topic, terms in ((0, slice(10, 20)), (1, slice(30, 45)), (2, slice(20, 30)), (3, slice(0, 10)), (4, slice(45, 60))):
        phi[terms, topic] = 0.1
    assert S.topic_subjects(phi, counts, ["a", "b", "c"]) == ["b", None, "c", "a", None, *[None] * (k - 5)]


def test_labels_do_not_enter_the_passes():
    """Sentence mixtures are the same whatever raters gave to the document."""
    import pandas as pd

    k, phi = 3 + S.BACKGROUND, np.random.default_rng(2).gamma(0.2, 1, (1 << S.HASH_BITS, 3 + S.BACKGROUND)).astype(np.float32)
    rows = [pd.DataFrame({"doc_id": [1], "votes": [v], "text": ["One two three. Four five."]}) for v in (None, [1.0, 0.0, 0.0])]
    a, b = (S._Batch(next(S._encoded(iter([r]))), k).responsibilities(phi) for r in rows)
    assert (a == b).all()
