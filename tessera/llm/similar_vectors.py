"""Most similar vectors for every vector, by randomly rotated one-bit codes over soft cells.

Index. Unit vectors are rotated by a random orthonormal matrix and kept as the sign bit of each
coordinate, packed, with one correction scalar f = <code, rotated vector> (code scaled to unit length).
For a query q the inner product is estimated without bias by <code, rotated q> / f, and the estimate is
off by at most EPSILON * sqrt(1 - f^2) / (f * sqrt(dim - 1)) with overwhelming probability. Only vectors
whose upper bound reaches the wanted similarity and the query's k-th best lower bound are compared
exactly (reranked) in double precision.

Cells. About 2 * sqrt(n) centroids are fitted on a bounded sample (SAMPLE rows, a hash of the id picks
them); every row is indexed. In the self-search a row is placed in its SPILL nearest cells and is both
query and data there, so two rows meet when any of their nearest cells agree. In the search of a stated
query set, rows lie in one cell and queries visit the number of cells that a calibration finds.

Skew. Rows with equal vectors beyond the k + 1 of least id are answered without a search: their most
similar rows are the first k of them, at similarity 1. A query set is answered so as well where k + 1 rows
or more equal the query, and the cells to visit are calibrated on the others. A block that more than
BLOCK_QUERIES queries visit is worked on by several tasks, each with a part of the queries. A cell expected to hold more than CELL_ROWS rows
is split by a hash into parts, and each pair of parts is a task of its own, so no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.scale import materialize

SAMPLE = 32_768
MAX_CELLS = 16_384
SPILL = 3
EPSILON = 3.0
CELL_ROWS = 16_384
#: The search of a query set: the recall that decides how many cells it visits, queries to find that
#: number, rows of a block, queries beside them in a task, and a tighter bound, as the k-th best of
#: near-random vectors leaves little room.
RECALL, CALIBRATION, BLOCK_ROWS, BLOCK_QUERIES, SEARCH_EPSILON = 0.96, 256, 32_768, 65_536, 2.2
#: Share of a tile from which reranking it is one product.
DENSE = 0.02
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthonormal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(unit: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits [n, dim / 8] and correction scalars [n] of unit vectors."""
    turned = unit @ rot.T
    return np.packbits(turned > 0, axis=1), (np.abs(turned).sum(1) / np.sqrt(unit.shape[1])).astype(np.float32)


def estimate(turned: np.ndarray, codes: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products [queries, codes] of rotated queries, and each code's error bound."""
    dim = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32)
    signs = (signs * 2 - 1) / (np.sqrt(dim) * scalars[:, None])
    return turned @ signs.T, EPSILON * np.sqrt(np.maximum(1 - scalars**2, 0)) / (scalars * np.sqrt(dim - 1))


def usable(records: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): rows with ``dim`` finite values that are not all zero; null ids are left out."""
    v = F.col("v")
    r = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return r.where(F.col("id").isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))


def fit_cells(vectors: DataFrame, n: int, dim: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, share of the rows in each) from a sample of about SAMPLE rows, by k-means."""
    part = min(1.0, SAMPLE / max(n, 1))
    pick = vectors.where(F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(1 << 20)) < int(part * (1 << 20))).select("v").toArrow()
    x = np.asarray(pick.column("v").combine_chunks().flatten(), np.float32).reshape(-1, dim)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = int(np.clip(round(2 * n**0.5), 1, min(MAX_CELLS, max(len(x), 1))))
    if not len(x):
        return np.eye(1, dim, dtype=np.float32), np.ones(1)
    c = x[np.random.default_rng(SEED).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds + 1):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        count = np.bincount(near, minlength=k)
        if _ == rounds:
            break
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        s = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[full])[:-1]]), axis=0)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c[full] = np.where(norm > 0, s / np.maximum(norm, 1e-30), c[full])
    return c.astype(np.float32), count / len(x)


PLACED = pa.schema([("cell", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16()), ("part", pa.int16()), ("role", pa.int8()), ("id", pa.int64()), ("f", pa.float32()), ("code", pa.binary()), ("vec", pa.binary())])
_PLACED_DDL = "cell int, lo smallint, hi smallint, part smallint, role tinyint, id bigint, f float, code binary, vec binary"


def _place(cells: np.ndarray, parts: np.ndarray, dim: int, near: int, role: int):
    """mapInArrow function: a row for each of the ``near`` nearest cells (and pairs of their parts).

    role: 1 data, 2 query, 3 both. Vectors travel as half floats where that loses nothing.
    """
    rot = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 4096):
                b = big.slice(lo, 4096)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                raw = np.asarray(b.column(1).flatten(), np.float32).reshape(-1, dim)
                unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                score = unit @ cells.T
                t = min(near, len(cells))
                if t < len(cells):
                    top = np.argpartition(score, len(cells) - t, axis=1)[:, -t:]
                else:
                    top = np.broadcast_to(np.arange(t), (len(ids), t))
                codes, f = encode(unit, rot)
                with np.errstate(over="ignore"):
                    half = raw.astype(np.float16)
                exact = (half.astype(np.float32) == raw).all(1)
                vecs = [h if e else r for h, r, e in zip(_rows(half), _rows(raw), exact, strict=True)]
                row, cell = np.repeat(np.arange(len(ids)), t), top.ravel()
                split = parts[cell]
                own = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % split
                if role == 3:  # pairs (lo, hi) of parts of which one is the row's own
                    copies = split
                    other = _within(copies)
                    row, cell, own = (np.repeat(a, copies) for a in (row, cell, own))
                    first, last = np.minimum(own, other), np.maximum(own, other)
                elif role == 2:  # a query visits every part
                    first = last = _within(split)
                    row, cell = np.repeat(row, split), np.repeat(cell, split)
                    own = first
                else:
                    first = last = own
                cols = [cell.astype(np.int32), first.astype(np.int16), last.astype(np.int16), own.astype(np.int16), np.full(len(row), role, np.int8), ids[row].astype(np.int64), f[row]]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(_rows(codes), pa.binary()).take(at), pa.array(vecs, pa.binary()).take(at)], schema=PLACED)

    return run


def _rows(a: np.ndarray) -> list[bytes]:
    """The bytes of each row."""
    data, width = np.ascontiguousarray(a).tobytes(), a.shape[1] * a.itemsize
    return [data[i : i + width] for i in range(0, len(data), width)]


def _within(copies: np.ndarray) -> np.ndarray:
    """0, 1, .. for each repetition."""
    ends = np.cumsum(copies)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - copies, copies)


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.to_pylist()
    out = np.empty((len(values), dim), np.float32)
    for width, kind in ((2 * dim, np.float16), (4 * dim, np.float32)):
        at = [i for i, v in enumerate(values) if len(v) == width]
        if at:
            out[at] = np.frombuffer(b"".join(values[i] for i in at), kind).reshape(-1, dim)
    return out


FOUND = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])


def _search(dim: int, k: int, least: float):
    """applyInArrow function over one cell (or pair of its parts): the k best of each query in it."""
    rot = rotation(dim)

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        role, part = t.column("role").to_numpy(), t.column("part").to_numpy()
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        data, query = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        if not len(data) or not len(query):
            return FOUND.empty_table()
        raw = _vectors(t.column("vec"), dim)
        unit = raw.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        turned = (unit @ rot.T.astype(np.float64)).astype(np.float32)
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        f = t.column("f").to_numpy()
        found = []
        for a in range(0, len(query), 512):
            q = query[a : a + 512]
            qi, di, sim = [], [], []
            for c in range(0, len(data), 2048):
                x = data[c : c + 2048]
                est, err = estimate(turned[q], codes[x], f[x])
                est += err
                r, s = np.nonzero(est >= least)
                if len(r) > 8 * k * len(q):  # many may reach the similarity: only those that reach the k-th best lower bound
                    low = est - 2 * err
                    kth = np.partition(low, max(low.shape[1] - k - 1, 0), axis=1)[:, max(low.shape[1] - k - 1, 0)]
                    r, s = np.nonzero(est >= np.maximum(kth, least)[:, None])
                keep = ids[q[r]] != ids[x[s]]
                if lo != hi:
                    keep &= part[q[r]] != part[x[s]]
                qi.append(r[keep])
                di.append(x[s[keep]])
                sim.append(np.concatenate([np.einsum("ij,ij->i", unit[q[r[keep][i : i + 4096]]], unit[x[s[keep][i : i + 4096]]]) for i in range(0, keep.sum(), 4096)] or [np.empty(0)]))
            r, x, v = np.concatenate(qi), np.concatenate(di), np.concatenate(sim)
            r, x, v = (z[v >= least] for z in (r, x, v))
            order = np.lexsort((ids[x], -v, r))
            r, x, v = r[order], x[order], v[order]
            best = _within(np.bincount(r, minlength=len(q))) < k
            found.append((ids[q[r[best]]], ids[x[best]], v[best]))
        return pa.table([np.concatenate([z[i] for z in found]) for i in range(3)], schema=FOUND)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each id, ties by the lesser id."""
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), F.asc("other"))
    return found.groupBy("id", "other").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _searched(placed: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    return placed.groupBy("cell", "lo", "hi").applyInArrow(_search(dim, k, least), "id bigint, other bigint, similarity double")


def _keyed(v: DataFrame) -> DataFrame:
    return v.select("id", F.xxhash64("v").alias("g"), F.hash("v").alias("g2"))


def _crowded(v: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """Of the vectors that more than k + 1 rows share: (the k + 1 rows of least id with their rank r, the other rows).

    Rows with (id, g, g2); None if no vector is shared so often. Ranks are cut before the shuffle.
    """
    keys = _keyed(v)
    crowded = materialize(keys.groupBy("g", "g2").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > k + 1))
    if not crowded.limit(1).count():
        return None
    inside = keys.join(crowded.select("g", "g2"), ["g", "g2"])
    first = F.row_number().over(Window.partitionBy("g", "g2").orderBy("id"))
    heads = materialize(inside.withColumn("r", first).where(F.col("r") <= k + 1))
    return heads, materialize(inside.join(heads.select("id"), "id", "left_anti"))


def _answered(rows: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """(id, other, similarity, rank): the first k rows of equal vector for each of ``rows`` (id, g, g2) that has such."""
    o = heads.groupBy("g", "g2").agg(F.sort_array(F.collect_list("id")).alias("o"))
    j = rows.join(o, ["g", "g2"]).select("id", F.posexplode(F.slice(F.filter("o", lambda x: x != F.col("id")), 1, k)).alias("i", "other"))
    return j.select("id", "other", F.lit(1.0).alias("similarity"), (F.col("i") + 1).alias("rank"))


def most_similar(records: DataFrame, id_col: str = "id", vec_col: str = "embedding", *, dim: int = 64, k: int = 10, least: float = -1.0, spill: int = SPILL) -> DataFrame:
    """(id, other, similarity, rank): for every row with a usable vector its k most similar rows.

    Only pairs of cosine similarity ``least`` or more are given; the higher it is, the surer the cells
    find them (see the README for measured recall). Unusable vectors (null, another width, all zero,
    not finite) and null ids take no part; of equal similarities the lesser id ranks first; an empty
    table gives no row. Ids are expected to be unique.
    """
    v = usable(records, id_col, vec_col, dim)
    n = v.count()
    crowd = _crowded(v, k)
    copies = None
    if crowd is not None:
        heads, rest = crowd
        copies = _answered(rest, heads, k)
        v = v.join(rest.select("id"), "id", "left_anti")
    cells, share = fit_cells(v, n, dim)
    parts = np.maximum(1, np.ceil(share * n * spill / CELL_ROWS)).astype(np.int64)
    placed = v.mapInArrow(_place(cells, parts, dim, spill, 3), _PLACED_DDL)
    out = _best(_searched(placed, dim, k, least), k)
    return out if copies is None else out.unionByName(copies)


BLOCKED = "block int, part int, role tinyint, id bigint, cell int, f float, code binary, vec binary, cells binary"


def _place_blocks(cells: np.ndarray, order: tuple[np.ndarray, np.ndarray], parts: np.ndarray, dim: int, visits: int | None):
    """mapInArrow function: data rows (``visits`` None) go to their cell's block, or one of its blocks by id;
    a query goes once to each block that has any of its ``visits`` nearest cells, with the list of them.

    ``order`` gives each cell's first block and number of blocks, ``parts`` how many tasks share a block:
    data go to all of them, a query to one.
    """
    blocks = len(parts)
    rot = rotation(dim)
    first, wide = order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2048):
                b = big.slice(lo, 2048)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                raw = np.asarray(b.column(1).flatten(), np.float32).reshape(-1, dim)
                unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                score = unit @ cells.T
                codes, f = encode(unit, rot)
                row = np.arange(len(ids))
                if visits is None:
                    cell = score.argmax(1)
                    block = first[cell] + ids % wide[cell]
                    part = _within(parts[block])
                    row = np.repeat(row, parts[block])
                    cell, block, lists = cell[row], block[row], [b""] * len(row)
                else:
                    near = np.argpartition(score, len(cells) - visits, axis=1)[:, -visits:] if visits < len(cells) else np.tile(np.arange(len(cells)), (len(ids), 1))
                    row, c = np.repeat(row, near.shape[1]), near.ravel()
                    row, c = np.repeat(row, wide[c]), np.repeat(c, wide[c])
                    at = first[c] + _within(wide[near.ravel()])
                    key = row * blocks + at
                    o = np.lexsort((c, key))
                    key, c = key[o], c[o].astype(np.int32)
                    start = np.flatnonzero(np.diff(key, prepend=-1))
                    lists = [x.tobytes() for x in np.split(c, start[1:])]
                    row, block = key[start] // blocks, key[start] % blocks
                    cell = np.full(len(row), -1)
                    part = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts[block]
                take = pa.array(row)
                cols = [pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(row), 1 if visits is None else 2, np.int8)), pa.array(ids[row].astype(np.int64)), pa.array(cell.astype(np.int32)), pa.array(f[row])]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(_rows(codes), pa.binary()).take(take), pa.array(_rows(raw), pa.binary()).take(take), pa.array(lists, pa.binary())], names=["block", "part", "role", "id", "cell", "f", "code", "vec", "cells"])

    return run


def _search_blocks(dim: int, k: int):
    """applyInArrow function over a block of cells: the k best rows of each query that visits it."""
    rot = rotation(dim)

    def run(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        d, q = t.filter(pa.array(role == 1)), t.filter(pa.array(role == 2))
        if not d.num_rows or not q.num_rows:
            return FOUND.empty_table()
        d = d.sort_by("cell")
        ids, qids, cell, f = d.column("id").to_numpy(), q.column("id").to_numpy(), d.column("cell").to_numpy(), d.column("f").to_numpy()
        unit, asked = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (_vectors(x.column("vec"), dim).astype(np.float64) for x in (d, q)))
        codes = np.frombuffer(b"".join(d.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        unit32, asked32 = unit.astype(np.float32), asked.astype(np.float32)
        turned = asked32 @ rot.T
        lists = [np.frombuffer(x, np.int32) for x in q.column("cells").to_pylist()]
        who, want = np.repeat(np.arange(len(qids)), [len(x) for x in lists]), np.concatenate(lists)
        o = np.argsort(want, kind="stable")
        who, want = who[o], want[o]
        best, names = np.full((len(qids), k), -2.0), np.full((len(qids), k), -1, np.int64)
        for c in np.unique(cell):
            lo, hi = np.searchsorted(cell, [c, c + 1])
            near = who[slice(*np.searchsorted(want, [c, c + 1]))]
            for a in range(0, len(near), 1024):
                n = near[a : a + 1024]
                for x in range(lo, hi, 2048):
                    y = min(x + 2048, hi)
                    est, err = estimate(turned[n], codes[x:y], f[x:y])
                    err *= SEARCH_EPSILON / EPSILON
                    r, s = np.nonzero(est + err >= best[n, -1:])
                    keep = qids[n[r]] != ids[x + s]
                    r, s = r[keep], s[keep]
                    if len(r) > DENSE * est.size:  # many to rerank: one product is cheaper than pair by pair
                        sim = (asked32[n] @ unit32[x:y].T)[r, s].astype(np.float64)
                    else:
                        sim = np.einsum("ij,ij->i", asked32[n[r]], unit32[x + s]).astype(np.float64)
                    ok = sim >= best[n[r], -1]
                    r, s, sim = n[r[ok]], ids[x + s[ok]], sim[ok]
                    got = np.unique(r)
                    r = np.concatenate([r, np.repeat(got, k)])
                    sim, s = np.concatenate([sim, best[got].ravel()]), np.concatenate([s, names[got].ravel()])
                    o = np.lexsort((s, -sim, r))
                    r, s, sim = r[o], s[o], sim[o]
                    top = _within(np.bincount(r, minlength=len(qids))[got]) < k
                    best[got], names[got] = sim[top].reshape(-1, k), s[top].reshape(-1, k)
        r, j = np.nonzero(names >= 0)
        at = np.argsort(ids)
        exact = np.einsum("ij,ij->i", asked[r], unit[at[np.searchsorted(ids, names[r, j], sorter=at)]])
        return pa.table([qids[r], names[r, j], exact], schema=FOUND)

    return run


def visits_for(vectors: DataFrame, queries: DataFrame, cells: np.ndarray, dim: int, k: int, recall: float) -> int:
    """The fewest cells to visit so that the sampled queries find ``recall`` of their k nearest rows.

    About CALIBRATION queries (picked by a hash of the id) are compared with every row exactly; each
    neighbour counts at the rank its cell has for the query. At most k rows for each of them reach the
    driver.
    """
    n = queries.count()
    pick = F.pmod(F.xxhash64(F.col("id"), F.lit(SEED + 1)), F.lit(1 << 20)) < int(min(1.0, CALIBRATION / max(n, 1)) * (1 << 20))
    t = queries.where(pick).toArrow()
    if not t.num_rows:
        return len(cells)
    ids = t.column("id").to_numpy()
    q = np.asarray(t.column("v").combine_chunks().flatten(), np.float32).reshape(-1, dim)
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    rank = np.argsort(np.argsort(-(q @ cells.T), axis=1), axis=1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            x = np.asarray(b.column(1).flatten(), np.float32).reshape(-1, dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            home = np.concatenate([(x[i : i + 4096] @ cells.T).argmax(1) for i in range(0, len(x), 4096)])
            sim = q @ x.T
            sim[ids[:, None] == own[None, :]] = -2
            m = min(k, len(own))
            top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
            at = np.repeat(np.arange(len(q)), m)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sim[at, top.ravel()].astype(np.float64)), pa.array(rank[at, home[top.ravel()]])], names=["q", "sim", "rank"])

    near = vectors.mapInArrow(run, "q bigint, sim double, rank int")
    w = Window.partitionBy("q").orderBy(F.desc("sim"))
    ranks = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("rank").toArrow().column("rank").to_numpy()
    return int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else len(cells)


def search(records: DataFrame, queries: DataFrame, id_col: str = "id", vec_col: str = "embedding", *, dim: int = 64, k: int = 10, recall: float = RECALL) -> DataFrame:
    """(id, other, similarity, rank): the k most similar of ``records`` for each row of ``queries``.

    A query visits as many of its nearest cells as a bounded sample of the queries needs to find
    ``recall`` of its true neighbours (1.0 visits all that any of them needs); measured recall is in the
    README. A query's own id is not its neighbour. Unusable vectors take no part on either side; ids are
    not negative. Cells are gathered into blocks of about BLOCK_ROWS
    rows and a bigger cell is cut into several blocks by id, so no task holds an unbounded group.
    """
    v, q = usable(records, id_col, vec_col, dim), usable(queries, id_col, vec_col, dim)
    crowd, copies = _crowded(v, k), None
    if crowd is not None:
        heads, rest = crowd
        v = v.join(rest.select("id"), "id", "left_anti")
        known = materialize(_keyed(q).join(heads.select("g", "g2").distinct(), ["g", "g2"]))
        copies = _answered(known, heads, k)
        q = q.join(known.select("id"), "id", "left_anti")
    n = v.count()
    cells, share = fit_cells(v, n, dim)
    size = share * n
    wide = np.maximum(1, np.ceil(size / BLOCK_ROWS)).astype(np.int64)
    group = np.floor(np.cumsum(np.where(wide > 1, 0, size)) / BLOCK_ROWS).astype(np.int64)
    first = np.where(wide > 1, group.max() + 1 + np.cumsum(np.where(wide > 1, wide, 0)) - wide, group)
    parts = np.ones(int((first + wide).max()), np.int64)
    visits = visits_for(v, q, cells, dim, k, recall)
    asked = q.mapInArrow(_place_blocks(cells, (first, wide), parts, dim, visits), BLOCKED)
    for r in asked.groupBy("block").count().where(F.col("count") > BLOCK_QUERIES).collect():  # at most a row for each block
        parts[r["block"]] = -(-r["count"] // BLOCK_QUERIES)
    place = lambda df, visits: df.mapInArrow(_place_blocks(cells, (first, wide), parts, dim, visits), BLOCKED)
    out = _best(place(v, None).unionByName(place(q, visits)).groupBy("block", "part").applyInArrow(_search_blocks(dim, k), "id bigint, other bigint, similarity double"), k)
    return out if copies is None else out.unionByName(copies)
