"""Near-duplicate records with small edits, by covering locality-sensitive hashing.

A record is the set of runs of ``shingle`` successive words. Its signature has ``REPEATS`` blocks of
seven min-hash coordinates; two records agree in a coordinate with a chance equal to the Jaccard
similarity of their sets. A block is masked seven ways, each mask keeping the three coordinates of a line
of the Fano plane. Any two points miss at least two of the lines, so every pair whose blocks differ in at
most two coordinates (the covering radius: five of seven agree, an estimated similarity of 0.71) is certain
to collide in some table, as do four fifths of the pairs that differ in three and a fifth of those that
differ in four. Blocks are independent; a pair of similarity 0.5 is within reach of a block in half of all
cases, which gives 1 - 2^-REPEATS = 0.984, 0.993 at 0.55 and 0.9996 at 0.7.

Every record is hashed alike, whatever it shares with how many others, so recall does not depend on the
size of a group or of the collection. Equal sets are collapsed before hashing and expanded at the end.
Tables are joined by one equi-join on the masked block; the survivors are compared exactly.

Records made from one form meet in its blocks though they are no near-duplicates, and such pairs grow with the
square of the table. So records of a block that very many share (BLOCK) don't meet by it but by their rarer runs:
of two records with similarity t, the rarest ``n - ceil(t n) + 1`` of the longer one's n runs and the rarest
``n - ceil(2 t n / (1 + t)) + 1`` of the shorter one's always have a run in common, whatever order "rarer" means
for both, so no pair is lost; runs of the form are common and come last. A run that still has more than CELL
records is cut into parts, and each pair of parts is a key of its own, so no task holds it whole. Which blocks and
runs are frequent is told by a sample of the records, as it decides about the work's division only and never about
the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.hierarchy import connected_components
from tessera.scale import discard, materialize

#: The lines of the Fano plane: seven masks of three out of seven coordinates.
LINES = ((0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5))
REPEATS = 6
#: Records from which a masked block is divided by runs, records of a run in a part, and the part of the records
#: (1 in HOT_SAMPLE, by a hash of the id) that tells which blocks and runs are larger than that.
BLOCK, CELL, HOT_SAMPLE = 64, 4096, 8
#: The driver gathers the most frequent ones up to this number; others stay whole.
HOT_KEYS = 1 << 17
#: Runs are ordered by how often the sample has their bucket.
BUCKETS = 1 << 16



def words(text: Column) -> Column:
    """The longest runs of letters or digits, case ignored; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def shingle_sets(records: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int) -> DataFrame:
    """(id, s): the sorted distinct 64-bit hashes of the runs of words, of records with enough words.

    Whole texts are used. Null, empty and short texts have no row.
    """
    n = max(min_words, shingle)
    w = records.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).where((F.size("w") >= n) & F.col("id").isNotNull())
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (shingle - 1)), lambda i: F.xxhash64(F.slice(F.col("w"), i, shingle)))
    return w.select("id", F.array_sort(F.array_distinct(runs)).alias("s"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (xor-shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signatures(sets: list[np.ndarray], coordinates: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Min-hash coordinates [n, coordinates] and packed one-bit sketches [n, bits / 64]."""
    flat = np.concatenate(sets).view(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    coords = np.empty((len(sets), coordinates), np.uint64)
    sketch = np.zeros((len(sets), bits // 64), np.uint64)
    for k in range(coordinates + bits):
        least = np.minimum.reduceat(_mix(flat + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), starts)
        if k < coordinates:
            coords[:, k] = least
        else:
            j = k - coordinates
            sketch[:, j // 64] |= (least & np.uint64(1)) << np.uint64(j % 64)
    return coords, sketch


def _masked(coords: np.ndarray, repeats: int) -> np.ndarray:
    """[n, 7 * repeats]: the hash of each block under each mask."""
    keys = []
    for r in range(repeats):
        c = coords[:, 7 * r : 7 * r + 7][:, np.array(LINES)]  # [n, 7 masks, 3 coordinates]
        k = _mix(c[:, :, 0] + np.uint64(7 * r + 1))
        for j in (1, 2):
            k = _mix(k * np.uint64(3) + c[:, :, j])
        keys.append(k + np.arange(7, dtype=np.uint64) + np.uint64(7 * r))
    return np.concatenate(keys, axis=1).view(np.int64)


def _parts(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for lo in range(0, len(b), 2000):
        yield b.iloc[lo : lo + 2000]


def _keys(repeats: int):
    """mapInPandas function: (key) of each record and masked block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p for b in batches for p in _parts(b)):
            yield pd.DataFrame({"key": _masked(_signatures([np.asarray(s, np.int64) for s in part["s"]], 7 * repeats, 0)[0], repeats).ravel()})

    return run


def _bucket(runs: np.ndarray) -> np.ndarray:
    return (_mix(runs.view(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas function: (bucket, count) of the runs."""
    count = np.zeros(BUCKETS, np.int64)
    for part in (p for b in batches for p in _parts(b)):
        count += np.bincount(_bucket(np.concatenate([np.asarray(s, np.int64) for s in part["s"]])), minlength=BUCKETS)
    yield pd.DataFrame({"bucket": (at := np.flatnonzero(count)), "count": count[at]})


def _rarest(sets: list[np.ndarray], seen: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, position of its set, short) of the rarer runs of each set; short: also among those it needs against a longer one."""
    n = np.array([len(s) for s in sets])
    run, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    run = run[np.lexsort((run, seen[_bucket(run)], row))]
    rank = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    long, short = (n - np.ceil(x * n - 1e-9) + 1 for x in (threshold, 2 * threshold / (1 + threshold)))
    kept = rank < long[row]
    return run[kept], row[kept], (rank < short[row])[kept]


def _run_keys(runs: np.ndarray) -> np.ndarray:
    return _mix(runs.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def _within(keys: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted ``some``, and its place there."""
    at = np.searchsorted(some, keys)
    return (some[np.minimum(at, len(some) - 1)] == keys if len(some) else np.zeros(keys.shape, bool)), at


def _tables(repeats: int, threshold: float, hot: np.ndarray, seen: np.ndarray, crowded: np.ndarray, parts: np.ndarray):
    """mapInPandas function: a row (key, id, tag) for each record and masked block; for hot blocks, for each of its rarer runs.

    ``tag`` is 8 times the number of runs, 4 if the key serves against longer records too, and the side. Rows of a
    side, 1 or 2, are only to meet those of the other; all rows of side 0 are to meet. A crowded run has a row for
    each pair of parts of which one is the record's own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p for b in batches for p in _parts(b)):
            sets, ids = [np.asarray(s, np.int64) for s in part["s"]], part["id"].to_numpy(np.int64)
            n = np.array([len(s) for s in sets])
            key = _masked(_signatures(sets, 7 * repeats, 0)[0], repeats)
            is_hot = _within(key, hot)[0]
            row, _ = np.nonzero(~is_hot)
            yield pd.DataFrame({"key": key[~is_hot], "id": ids[row], "tag": (n[row] * 8 + 4).astype(np.int32)})
            own = np.flatnonzero(is_hot.any(axis=1))
            if not len(own):
                continue
            r, row, short = _rarest([sets[i] for i in own], seen, threshold)
            key, row = _run_keys(r), own[row]
            tag = n[row] * 8 + short * 4
            many, at = _within(key, crowded)
            yield pd.DataFrame({"key": key[~many], "id": ids[row[~many]], "tag": tag[~many].astype(np.int32)})
            if many.any():
                key, row, tag, times = key[many], row[many], tag[many], parts[at[many]]
                mine = (_mix(ids[row].view(np.uint64)) % times.astype(np.uint64)).astype(np.int64)
                k = np.repeat(np.arange(len(key)), times)
                other, mine = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times), mine[k]
                pair = (np.minimum(mine, other) * (1 << 24) + np.maximum(mine, other) + 1).view(np.uint64)
                side = np.where(mine == other, 0, np.where(mine < other, 2, 1))
                yield pd.DataFrame({"key": _mix(key[k].view(np.uint64) ^ _mix(pair)).view(np.int64), "id": ids[row[k]], "tag": (tag[k] + side).astype(np.int32)})

    return run


def _sampled(reps: DataFrame) -> DataFrame:
    return reps.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0).select("s")


def _frequent(keys: DataFrame, least: int) -> DataFrame:
    """(key, parts): the keys of a sample expected to hold more than ``least`` records, and into how many parts of CELL to cut each."""
    count = F.col("count") * HOT_SAMPLE
    most = keys.groupBy("key").count().where(count > least).orderBy(F.desc("count"), "key").limit(HOT_KEYS)
    return most.select("key", F.ceil(count / CELL).cast("int").alias("parts"))


def _hot_blocks(reps: DataFrame, repeats: int) -> DataFrame:
    """(key, parts) of the masked blocks to divide by runs."""
    return _frequent(_sampled(reps).mapInPandas(_keys(repeats), "key bigint"), BLOCK)


def _gathered(frequent: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their parts."""
    rows = sorted((r["key"], r["parts"]) for r in frequent.collect())
    return np.array([k for k, _ in rows], np.int64), np.array([p for _, p in rows], np.int64)


def _divided(reps: DataFrame, repeats: int, threshold: float) -> DataFrame:
    """(key, id, tag) of all records, as :func:`_tables` has them."""
    none = np.array([], np.int64)
    seen, crowded, parts = np.zeros(BUCKETS, np.int64), none, none
    hot, _ = _gathered(_hot_blocks(reps, repeats))
    if len(hot):
        for r in _sampled(reps).mapInPandas(_bucket_counts, "bucket bigint, count bigint").groupBy("bucket").agg(F.sum("count").alias("n")).collect():
            seen[r["bucket"]] = r["n"]
        runs = _sampled(reps).withColumn("id", F.lit(0).cast("bigint")).mapInPandas(_tables(repeats, threshold, hot, seen, none, none), "key bigint, id bigint, tag int")
        crowded, parts = _gathered(_frequent(runs, CELL))
    return reps.mapInPandas(_tables(repeats, threshold, hot, seen, crowded, parts), "key bigint, id bigint, tag int")


def _met(tables: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: the records that meet in some key and whose sizes allow the threshold."""
    x, y = tables.alias("x"), tables.alias("y")
    size, short, side = lambda t: F.shiftright(t, 3), lambda t: t.bitwiseAND(4) > 0, lambda t: t.bitwiseAND(3)
    tx, ty = F.col("x.tag"), F.col("y.tag")
    near = F.least(size(tx), size(ty)) >= F.greatest(size(tx), size(ty)) * F.lit(threshold - 1e-9)
    serves = F.when(size(tx) > size(ty), short(ty)).otherwise(short(tx))
    apart = (side(tx) == 0) | (side(tx) != side(ty))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & near & serves & apart).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return pairs.distinct()


def _equal_groups(sets: DataFrame) -> DataFrame:
    """(id, rep): rep is the least id with the same set; the set's 128-bit digest is the key.

    Partial aggregation happens before the shuffle; the join back splits hot digests by AQE.
    """
    digest = F.struct(F.xxhash64("s"), F.hash("s"), F.size("s"))
    keyed = sets.select("id", digest.alias("g"))
    rep = keyed.groupBy("g").agg(F.min("id").alias("rep"))
    return keyed.join(rep, "g").select("id", "rep")


def near_duplicate_links(records: DataFrame, id_col: str = "id", text_col: str = "content", *, shingle: int = 5, threshold: float = 0.8, min_words: int = 1, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: (a, b, similarity) between representatives of different sets, a < b;
    members: (id, rep) for every record that takes part, rep the least id with an equal set.

    Null ids and texts, empty texts and texts under ``min_words`` words take no part. An empty table
    gives two empty frames. Ids are expected to be unique.
    """
    sets = materialize(shingle_sets(records.select(id_col, text_col), id_col, text_col, shingle, min_words))
    members = materialize(_equal_groups(sets), free=True)
    reps = sets.join(members.where("id = rep").select("id"), "id", "left_semi")
    pairs = materialize(_met(_divided(reps, repeats, threshold), threshold), free=True)
    sa, sb = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b").withColumn("c", F.size(F.array_intersect("sa", "sb")))
    links = both.select("a", "b", (F.col("c") / (F.size("sa") + F.size("sb") - F.col("c"))).alias("similarity")).where(F.col("similarity") >= threshold)
    links = materialize(links, free=True)
    discard(sets, pairs)
    return links, members


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, similarity) for all records: links between members of linked sets and within a set."""
    m = members
    cross = links.withColumnRenamed("a", "ra").withColumnRenamed("b", "rb").join(m.select(F.col("rep").alias("ra"), F.col("id").alias("x")), "ra").join(m.select(F.col("rep").alias("rb"), F.col("id").alias("y")), "rb")
    cross = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    inner = m.select("rep", F.col("id").alias("a")).join(m.select("rep", F.col("id").alias("b")), "rep").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return cross.unionByName(inner)


def near_duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group_id, links): the least id of the record's connected component and its links to other sets.

    Every record that takes part has one row; a record without near-duplicates is its own group.
    """
    comp = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    g = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return g.select("id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
