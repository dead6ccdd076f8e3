"""Documents into containers of fixed capacity, by patterns fitted to the length histogram.

Only the histogram of lengths (at most ``capacity`` numbers, however many documents) reaches the driver.
There, the lengths are cut into classes of little spread, patterns of up to three classes that fill a
container are enumerated, non-negative least squares fits how often each is repeated to the classes'
histogram (but for some short documents that are kept back), and the repeats are rounded by largest remainder. The containers of the fit then get lengths
class by class, from the longest down, the fullest containers the shortest lengths; where the lengths
drawn overflow, the shortest that relieves the container is taken out again. What is left, about a tenth of the
documents and most of them short, is packed best fit first into what room is left. The plan is a list of ranges of ranks
within each length, so a document finds its container by its rank alone, in parallel and without regard
to how many documents share a length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.scale import prefix_sums

CAPACITY = 2048
#: Length classes: one for EACH containers, so that patterns are repeated some times, within these bounds.
EACH, LEAST_CLASSES, MOST_CLASSES = 2, 6, 32
#: Part of the documents that is left to fill gaps: of each length up to the median the double of it.
KEPT_BACK = 0.08
#: How often one class is tried in a pattern (and as often as fits).
TIMES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)


def pieces(lengths: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, n): a document as one item, or cut every ``capacity`` tokens if it is longer."""
    d = lengths.where("n_tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / capacity))))
    start = F.col("piece") * capacity
    return d.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("bigint").alias("n"))


def length_classes(histogram: np.ndarray, k: int) -> np.ndarray:
    """Longest length of each of at most ``k`` classes with the least squared spread within them."""
    length = np.flatnonzero(histogram)
    d, k = len(length), min(k, len(length))
    w, x = histogram[length].astype(float), length.astype(float)
    n, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * x, w * x * x))
    i, j = np.arange(d)[:, None], np.arange(1, d + 1)[None, :]
    spread = np.where(j > i, q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(n[j] - n[i], 1), np.inf)
    best, back = np.concatenate([[0.0], np.full(d, np.inf)]), np.zeros((k, d), np.int64)
    for t in range(k):
        total = best[:-1, None] + spread
        back[t] = total.argmin(0)
        best = np.concatenate([[np.inf], total.min(0)])
    ends, at = [], d
    for t in range(k - 1, -1, -1):
        ends.append(at)
        at = back[t, at - 1]
    return length[np.array(ends[::-1], np.int64) - 1] if d else length


def enumerate_patterns(mean: np.ndarray, capacity: int) -> np.ndarray:
    """[patterns, classes]: how many documents of each class, up to three classes, of ``mean`` lengths.

    Only patterns in which not even a document of the shortest class finds room any more.
    """
    k = len(mean)
    one = [(c, t) for c in range(k) for t in sorted({*TIMES, int(capacity // mean[c])}) if 0 < t * mean[c] <= capacity]
    c, t = (np.array(v, np.int64) for v in zip(*one, strict=True))
    size = t * mean[c]
    a, b = np.nonzero((c[:, None] > c[None, :]) & (size[:, None] + size[None, :] <= capacity))
    counts = np.zeros((len(one) + len(a), k), np.int32)
    counts[np.arange(len(one)), c] = t
    row = np.arange(len(a)) + len(one)
    counts[row, c[a]] = t[a]
    counts[row, c[b]] = t[b]
    room = capacity - counts @ mean
    found = [counts[room < mean[0]]]
    for x in range(k):
        more = np.floor(room / mean[x] + 1e-9).astype(np.int32)
        ok = (more > 0) & (room - more * mean[x] < mean[0]) & (counts[:, x] == 0)
        found.append(counts[ok])
        found[-1][:, x] = more[ok]
    return np.unique(np.concatenate(found), axis=0)


def non_negative_fit(patterns: np.ndarray, histogram: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often to repeat each pattern: least squares against the classes' histogram under x >= 0.

    By an active set: the pattern that lessens the misfit most comes in, and patterns that would turn
    negative go out. At most one pattern for each class is used in the end.
    """
    rows, goal = patterns * weight, histogram * weight
    norm = np.maximum(np.linalg.norm(rows, axis=1), 1e-12)
    x, used = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for _ in range(10 * len(histogram)):
        gain = np.where(used, -np.inf, rows @ (goal - x @ rows) / norm)
        j = int(gain.argmax())
        if gain[j] <= 1e-9 * np.linalg.norm(goal):
            break
        used[j] = True
        while True:
            at = np.flatnonzero(used)
            z = np.linalg.lstsq(rows[at].T, goal, rcond=None)[0]
            low = z <= 1e-9
            if not low.any():
                x[at] = z
                break
            # as far towards z as no repeat turns negative
            step = (x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min()
            x[at] += step * (z - x[at])
            used[at] = x[at] > 1e-9
            x[~used] = 0
    return x


def rounded(x: np.ndarray, patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeats by largest remainder, never more than the histogram holds."""
    times = np.zeros(len(x), np.int64)
    left = histogram.astype(np.int64).copy()
    whole = np.floor(x + 1e-9).astype(np.int64)
    for j in [*np.argsort(-whole, kind="stable")[: np.count_nonzero(whole)], *(j for j in np.argsort(whole - x, kind="stable") if x[j] - whole[j] > 1e-9)]:
        need = patterns[j] > 0
        t = min(int((left[need] // patterns[j][need]).min()), max(int(whole[j] - times[j]), 1))
        times[j] += t
        left -= t * patterns[j]
    return times


class _Load:
    """Equal containers: lengths of the fit, lengths packed later, how many of them there are."""

    __slots__ = ("fitted", "later", "times", "used")

    def __init__(self, fitted: dict[int, int], later: dict[int, int], times: int):
        self.fitted, self.later, self.times = fitted, later, times
        self.used = sum(x * t for d in (fitted, later) for x, t in d.items())

    def with_more(self, lengths: dict[int, int], times: int, fitted: bool) -> _Load:
        both = [dict(self.fitted), dict(self.later)]
        for x, t in lengths.items():
            both[not fitted][x] = both[not fitted].get(x, 0) + t
        return _Load(*both, times)


def _draw(load: _Load, per: int, lengths: list[list[int]]) -> list[_Load]:
    """``load`` with ``per`` more documents a container, from the front of ``lengths`` ([length, count])."""
    out, todo = [], load.times
    while todo:
        x, there = lengths[0]
        if there >= per:
            t, more = min(todo, there // per), {x: per}
        else:  # a container at the border of two lengths or more
            t, more, need = 1, {}, per
            for y, n in lengths:
                more[y] = min(need, n)
                need -= more[y]
                if not need:
                    break
        out.append(load.with_more(more, t, True))
        todo -= t
        for y, n in more.items():
            next(e for e in lengths if e[0] == y)[1] -= n * t
        while lengths and not lengths[0][1]:
            lengths.pop(0)
    return out


def _realised(patterns: np.ndarray, times: np.ndarray, classes: list[np.ndarray], mean: np.ndarray, left: np.ndarray, capacity: int) -> list[_Load]:
    """The fitted containers with real lengths, taken out of ``left``; none is over the capacity."""
    loads = [(j, _Load({}, {}, int(times[j]))) for j in np.flatnonzero(times)]
    for c in range(len(mean) - 1, -1, -1):
        # room beyond what the classes still to come will need
        spare = lambda e: capacity - e[1].used - float(patterns[e[0], : c + 1] @ mean[: c + 1])  # noqa: B023, E731
        lengths = [[int(x), int(left[x])] for x in classes[c]]
        drawn = []
        for j, load in sorted((e for e in loads if patterns[e[0], c]), key=spare):
            drawn += [(j, one) for one in _draw(load, int(patterns[j, c]), lengths)]
        loads = [e for e in loads if not patterns[e[0], c]] + drawn
        left[classes[c]] = 0
        for x, n in lengths:
            left[x] = n
    out = []
    for _, load in loads:
        while load.used > capacity:
            over = load.used - capacity
            x = min((y for y in load.fitted if y >= over), default=max(load.fitted))
            left[x] += load.times
            kept = {y: t - (y == x) for y, t in load.fitted.items()}
            load = _Load({y: t for y, t in kept.items() if t}, {}, load.times)
        out.append(load)
    return out


def plan(histogram: np.ndarray) -> list[_Load]:
    """Containers that use up the histogram (index = length, 0 unused) exactly."""
    left = np.asarray(histogram, np.int64).copy()
    if not left.any():
        return []
    capacity, every = len(left) - 1, np.arange(len(left))
    # short documents for the gaps: the fit does not see them
    short = np.cumsum(left) <= left.sum() / 2
    back = np.where(short, (left * 2 * KEPT_BACK).astype(np.int64), 0)
    left -= back
    ends = length_classes(left, int(np.clip(left @ every / capacity // EACH, LEAST_CLASSES, MOST_CLASSES)))
    classes = [np.flatnonzero((left > 0) & (every > lo) & (every <= hi)) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
    counts = np.array([left[c].sum() for c in classes])
    mean = np.array([left[c] @ c for c in classes]) / counts
    patterns = enumerate_patterns(mean, capacity)
    times = rounded(non_negative_fit(patterns, counts, np.sqrt(mean)), patterns, counts)
    by_room: list[list[_Load]] = [[] for _ in range(capacity + 1)]
    for load in _realised(patterns, times, classes, mean, left, capacity):
        by_room[capacity - load.used].append(load)
    left += back
    for x in every[:0:-1]:  # the longest first, each where it leaves the least room
        while left[x]:
            room = next((r for r in range(x, capacity + 1) if by_room[r]), None)
            load = _Load({}, {}, int(-(-left[x] // (capacity // x)))) if room is None else by_room[room].pop()
            t = int(min(load.times, left[x]))
            per = int(min((capacity - load.used) // x, left[x] // t))
            left[x] -= per * t
            full = load.with_more({int(x): per}, t, False)
            by_room[capacity - full.used].append(full)
            if load.times > t:
                by_room[capacity - load.used].append(_Load(load.fitted, load.later, load.times - t))
    return [load for loads in by_room for load in loads if load.used]


def _ranges(loads: list[_Load]) -> tuple[np.ndarray, ...]:
    """By length: first rank, first container, documents per container and whether the fit placed it, sorted."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for load in loads:
        for fitted, lengths in ((1, load.fitted), (0, load.later)):
            for x, t in lengths.items():
                rows.append((x, taken.get(x, 0), first, t, fitted))
                taken[x] = taken.get(x, 0) + t * load.times
        first += load.times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 5


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, n, container, fitted): each document's container, from (doc_id, n_tokens).

    ``fitted`` tells whether a fitted pattern put it there or the packing of what was left.
    No container holds more than ``capacity`` tokens and only documents longer than it are divided.
    Documents without tokens need no container and have no row. Repeated doc_ids are items of their own.
    """
    items = prefix_sums(pieces(lengths, capacity), ["n"], ["doc_id", "piece", "start"], {"rank": F.lit(1).cast("bigint")})
    histogram = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("n").count().collect():  # at most ``capacity`` rows
        histogram[r["n"]] = r["count"]
    length, rank, container, per, fitted = _ranges(plan(histogram))
    key = length * (1 << 40) + rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, q = b.column(3).to_numpy(), b.column(4).to_numpy() - 1
            at = np.searchsorted(key, n * (1 << 40) + q, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(container[at] + (q - rank[at]) // per[at]), pa.array(fitted[at] == 1)], names=["doc_id", "piece", "start", "n", "container", "fitted"])

    return items.select("doc_id", "piece", "start", "n", "rank").mapInArrow(run, "doc_id bigint, piece bigint, start bigint, n bigint, container bigint, fitted boolean")


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, pieces, tokens, containers, the share of the capacity that is used and of the pieces that fitted patterns placed."""
    a = packed.agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_distinct("container").alias("containers"), F.avg(F.col("fitted").cast("int")).alias("fitted_share"))
    return a.withColumn("used_share", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)))
