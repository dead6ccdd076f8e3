"""Near-duplicates: the covering guarantee, recall against brute force, odd rows."""

import itertools
import random
import re

import pytest

from tessera.llm import near_duplicates as N

SCHEMA = "id bigint, content string, key bigint"


def runs(text: str, k: int) -> set:
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, threshold, least):
    sets = {i: runs(t, k) for i, t, _ in rows if t and i is not None and len(re.findall(r"[^\W_]+", t)) >= max(least, k)}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        c = len(sets[a] & sets[b])
        if c >= threshold * (len(sets[a]) + len(sets[b]) - c):
            out.add((a, b))
    return out


def corpus(seed: int, n: int):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 60))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [rng.choice(vocab)]
            rows.append((len(rows), " ".join(w), 7))
    return rows


def test_every_pair_within_the_radius_collides():
    for differ in itertools.chain.from_iterable(itertools.combinations(range(7), r) for r in range(3)):
        assert any(not set(line) & set(differ) for line in N.LINES)


@pytest.mark.parametrize(("k", "threshold", "least"), [(3, 0.5, 15), (5, 0.8, 1)])
def test_recall_and_precision(spark, k, threshold, least):
    rows = corpus(k, 400)
    links, members = N.near_duplicate_links(spark.createDataFrame(rows, SCHEMA), shingle=k, threshold=threshold, min_words=least)
    got = {(r.a, r.b) for r in N.expand_pairs(links, members).collect()}
    want = brute(rows, k, threshold, least)
    assert not got - want and len(got) >= 0.98 * len(want) and len(want) > 20


def test_copies_nulls_and_short_texts(spark):
    text = " ".join(f"word{i}" for i in range(30))
    long = " ".join(f"x{i}" for i in range(50_000))
    rows = [(1, text, 0), (2, text.upper() + "!", 0), (3, text, 0), (4, None, 0), (5, "", 0), (6, "too short", 0), (None, text, 0), (7, long, 0), (8, long + " more", 0), (9, "...", 0)]
    links, members = N.near_duplicate_links(spark.createDataFrame(rows, SCHEMA), shingle=3, threshold=0.5, min_words=15)
    assert {(r.a, r.b) for r in N.expand_pairs(links, members).collect()} == {(1, 2), (1, 3), (2, 3), (7, 8)}
    groups = {r.id: (r.group_id, r.links) for r in N.near_duplicate_groups(links, members).collect()}
    assert groups == {1: (1, 0), 2: (1, 0), 3: (1, 0), 7: (7, 1), 8: (7, 1)}


def test_empty_table(spark):
    links, members = N.near_duplicate_links(spark.createDataFrame([], SCHEMA))
    assert N.expand_pairs(links, members).count() == 0
    assert N.near_duplicate_groups(links, members).count() == 0


def edited(rng, name: str, members: int, words: int = 40):
    """Copies of one text whose ends are rewritten: pairs at about 0.4 to 0.8, all sharing the begin."""
    base = [f"{name}{i}" for i in range(words)]
    for i in range(members):
        e = rng.randrange(words // 7, words * 2 // 5)
        yield " ".join(base[: words - e] + [f"{name}e{i}x{j}" for j in range(e)])


@pytest.mark.parametrize("cell", [4096, 100])
def test_a_group_holding_a_third_of_the_rows(spark, monkeypatch, cell):
    """Blocks cut into parts give the same pairs as whole ones, each once."""
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "HOT_SAMPLE", 4)
    texts = [*edited(random.Random(5), "g", 400), *(" ".join(f"u{i}x{j}" for j in range(40)) for i in range(800))]
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if cell < 1000:
        reps = N.shingle_sets(df, "id", "content", 3, 15)
        assert N._hot_blocks(reps, N.REPEATS).where("parts > 1").count() > 0
    links, members = N.near_duplicate_links(df, shingle=3, threshold=0.5, min_words=15)
    got = [(r.a, r.b) for r in N.expand_pairs(links, members).collect()]
    want = brute(rows, 3, 0.5, 15)
    assert len(want) > 20_000 and len(got) == len(set(got)) and not set(got) - want and len(got) >= 0.95 * len(want)


@pytest.mark.parametrize(("members", "others"), [(90, 300), (90, 3000), (400, 2000), (2000, 2000)])
def test_recall_does_not_depend_on_the_size_of_a_group(members, others):
    """Pairs of 0.5 and more of one group meet in some masked block, whatever its part of the collection."""
    import numpy as np
    import xxhash

    rng = random.Random(members + others)
    texts = [*edited(rng, "g", members, 60), *(" ".join(f"u{i}x{j}" for j in range(40)) for i in range(others))]
    sets = [np.array(sorted({xxhash.xxh64_intdigest(" ".join(r)) for r in runs(t, 3)}), np.uint64).view(np.int64) for t in texts]
    keys = np.concatenate([N._masked(N._signatures(sets[i : i + 500], 7 * N.REPEATS, 0)[0], N.REPEATS) for i in range(0, len(sets), 500)])
    own, met, close = [set(s.tolist()) for s in sets[:members]], [0, 0], [0, 0]
    for a, b in random.Random(1).sample(list(itertools.combinations(range(members), 2)), 4000):
        c = len(own[a] & own[b])
        j = c / (len(own[a]) + len(own[b]) - c)
        if j >= 0.5:
            hit = bool((keys[a] == keys[b]).any())
            met[0], close[0] = met[0] + hit, close[0] + 1
            met[1], close[1] = met[1] + (hit and j < 0.6), close[1] + (j < 0.6)
    assert close[1] > 300 and met[0] >= 0.95 * close[0] and met[1] >= 0.95 * close[1]


def test_records_of_one_form_do_not_meet_each_other(spark):
    """A form's records share blocks by the thousand and are no near-duplicates: few meet, all pairs are found."""
    rng = random.Random(3)
    form = [f"form{i}" for i in range(24)]
    texts = [" ".join([*form, *(f"v{rng.randrange(9000)}" for _ in range(20))]) for _ in range(700)]
    texts += [f"{t} once more" for t in texts[:40]]
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    met = N._met(N._divided(N.shingle_sets(df, "id", "content", 3, 15), N.REPEATS, 0.5), 0.5).count()
    links, members = N.near_duplicate_links(df, shingle=3, threshold=0.5, min_words=15)
    want = brute(rows, 3, 0.5, 15)
    assert {(r.a, r.b) for r in N.expand_pairs(links, members).collect()} == want and len(want) >= 40
    assert met < 0.1 * len(rows) ** 2 / 2
