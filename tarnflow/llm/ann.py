"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Vectors of length one are compared by Euclidean distance, whose order is the
cosine's.  A random rotation spreads each difference evenly over the
coordinates, so that the distance over the first d of D coordinates, scaled by
D / d, estimates the whole.  In each probed list a candidate is dropped after a
block of columns if that estimate exceeds the query's k-th best distance by
more than the test allows, (1 + epsilon / sqrt(d)); what is left after all
columns is scored exactly, on the original vectors in double precision.

Centroids come from a bounded sample of the candidates (about `sample` rows, or 16 a
list if more, of NUMBERS components in all); every candidate is indexed.  Lists lie side by side on a line as long
as the table, and equal stretches of that line are the cells that tasks hold: a hot
list covers many cells, small ones share one.  A query goes once to each cell that
holds a list it probes, with these lists' numbers, so candidates are shuffled once.

A query's k best in the sample, scored where the query is read, start the tests and
are results themselves.  How many lists are probed is measured on the sample, apart
for each list and for rows near and far from its centre, since crowded lists say
nothing of sparse ones: the nearest lists that hold `recall` of such rows' true
neighbours (the sample is sparser than the table, so its neighbours are farther off
and spread over more lists).  A query goes on to further lists until they hold k
candidates beside itself, and skips those that lie, by angle to the centre less the
list's radius, beyond its k-th best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, sampled
from .vectors import CELL, best, first_of_equals, matrix, meet, ranked, usable

#: Below this share of pairs left, pairs are handled one by one; else block by block.
SPARSE = 0.02
#: Numbers of the broadcast sample at most, of any width up to 8192 (64 MB).
NUMBERS = 1 << 23
#: Sample rows that tell how many lists their like must probe.
FEW = 8


def rotation(width: int, seed: int = 29) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diagonal(r))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that squares stay in range."""
    m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 31) -> np.ndarray:
    """Spherical k-means; an empty list takes the row farthest from its centre."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(sample))
    c = sample[rng.choice(len(sample), lists, replace=False)] if lists else np.zeros((0, sample.shape[1]))
    for _ in range(rounds):
        of, close = nearest_centres(sample, c)
        order = np.argsort(of, kind="stable")
        held, first = np.unique(of[order], return_index=True)
        total = np.zeros_like(c)
        if len(held):
            total[held] = np.add.reduceat(sample[order], first, axis=0)
        empty = np.flatnonzero(np.bincount(of, minlength=lists) == 0)
        total[empty] = sample[np.argsort(close, kind="stable")[: len(empty)]]
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def nearest_centres(rows: np.ndarray, c: np.ndarray, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centre and its cosine, a chunk of rows at a time."""
    of, close = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for a in range(0, len(rows), chunk):
        near = rows[a : a + chunk] @ c.T
        of[a : a + chunk] = near.argmax(axis=1)
        close[a : a + chunk] = near.max(axis=1)
    return of, close


def measured_probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """[lists, 2] numbers of nearest lists that hold `recall` of the k true neighbours, and each list's median cosine.

    Column 0 is for rows farther from their list's centre than its median, 1 for the
    others.  Where fewer than FEW rows tell, as many
    are taken as any list needs.
    """
    lists = len(centres)
    of, close = nearest_centres(sample, centres)
    order = np.lexsort((close, of))
    first, size = np.searchsorted(of[order], np.arange(lists)), np.bincount(of, minlength=lists)
    middle = np.array([close[order[a + n // 2]] if n else -1.0 for a, n in zip(first, size)])
    count = min(k, len(sample) - 1)
    if count < 1:
        return np.ones((lists, 2), np.int64), middle
    each = max(4, queries // lists)
    asked = np.concatenate([order[a + np.unique(np.linspace(0, n - 1, min(n, each)).astype(int))] for a, n in zip(first, size) if n])
    step = max(1, (1 << 22) // len(sample))
    needed = np.zeros((len(asked), count), np.int64)
    for a in range(0, len(asked), step):
        own = asked[a : a + step]
        near = sample[own] @ sample.T
        near[np.arange(len(own)), own] = -np.inf
        true = np.argpartition(-near, count - 1, axis=1)[:, :count]
        rank = np.argsort(np.argsort(-(sample[own] @ centres.T), axis=1, kind="stable"), axis=1)
        needed[a : a + step] = np.take_along_axis(rank, of[true], axis=1)
    out, few = np.zeros((lists, 2), np.int64), np.ones((lists, 2), bool)
    side = (close[asked] >= middle[of[asked]]).astype(int)
    for n in range(lists):
        for m in (0, 1):
            own = (of[asked] == n) & (side == m)
            ranks = np.sort(needed[own].ravel())
            if len(ranks):
                out[n, m] = ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1
            few[n, m] = own.sum() < FEW
    most = out.max()
    out[few] = most
    out[:, 0] = np.maximum(out[:, 0], out[:, 1])
    return out, middle


def best_of_sample(units: np.ndarray, own: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of the sample: query index, id, cosine; and its k-th cosine, -3 if there are fewer."""
    found, step = [], max(1, (1 << 22) // max(1, len(sample)))
    for a in range(0, len(units), step):
        part = units[a : a + step]
        near = part @ sample.T
        near[own[a : a + step, None] == ids[None, :]] = -np.inf
        count = min(k + 8, near.shape[1])  # a few more: equal scores rank by id
        top = np.argpartition(-near, count - 1, axis=1)[:, :count] if count else np.zeros((len(part), 0), np.int64)
        i, j = np.repeat(np.arange(len(part)), count), top.ravel()
        there = np.isfinite(near[i, j])
        i, j = i[there], j[there]
        score = (part[i] * sample[j]).sum(axis=1)
        kept = best(i, score, ids[j], k)
        found.append((i[kept] + a, ids[j[kept]], score[kept]))
    i, ident, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    worst = np.full(len(units), np.inf)
    np.minimum.at(worst, i, score)
    return i, ident, score, np.where(np.bincount(i, minlength=len(units)) == k, worst, -3.0)


class Cell:
    """Candidates by list: original vectors, unit ones, and these rotated."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, lists: np.ndarray, turn: np.ndarray):
        order = np.argsort(lists, kind="stable")
        self.ids, self.turn = ids[order], turn
        self.units = unit(v[order])
        self.turned = self.units @ turn
        self.numbers, self.begins = np.unique(lists[order], return_index=True)
        self.begins = np.append(self.begins, len(ids))


def scan(uq: np.ndarray, rq: np.ndarray, q_id: np.ndarray, limit: np.ndarray, uv: np.ndarray, rv: np.ndarray, v_id: np.ndarray, k: int, columns: int = 16, epsilon: float = 2.1, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of one list: query index, id, cosine; and the limits, lowered.

    uq, uv: unit vectors; rq, rv: the same, rotated.  limit: squared distance beyond which none counts.
    """
    dims = uq.shape[1]
    limit = limit.astype(float).copy()
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    q, v = rq, rv
    for a in range(0, len(v), step):
        own = slice(a, a + step)
        # Blocks of columns for all pairs, until few are left; then for those alone.
        d, part, alive = 0, 0.0, np.ones((len(q), len(v[own])), bool)
        while d < dims and np.count_nonzero(alive) >= SPARSE * alive.size:
            e = min(d + columns, dims)
            part = part + (np.square(rq[:, d:e]).sum(axis=1)[:, None] + np.square(rv[own, d:e]).sum(axis=1)[None, :] - 2 * rq[:, d:e] @ rv[own, d:e].T)
            slack = 1.0 if e == dims else (1 + epsilon / np.sqrt(e)) ** 2
            alive &= part * (dims / e) <= limit[:, None] * slack + 1e-9
            d = e
        i, j = np.nonzero(alive)
        part, j = part[i, j], j + a
        while d < dims and len(i):
            e = min(d + columns, dims)
            part = part + np.square(rq[i, d:e] - rv[j, d:e]).sum(axis=1)
            slack = 1.0 if e == dims else (1 + epsilon / np.sqrt(e)) ** 2
            keep = part * (dims / e) <= limit[i] * slack + 1e-9
            part, i, j, d = part[keep], i[keep], j[keep], e
        other = q_id[i] != v_id[j]
        i, j = i[other], j[other]
        score = (uq[i] * uv[j]).sum(axis=1)
        held = [np.concatenate(x) for x in zip(held, (i, v_id[j], score))]
        top = best(held[0], held[2], held[1], k)
        held = [x[top] for x in held]
        full = np.bincount(held[0], minlength=len(q)) == k
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, held[0], held[2])
        limit = np.where(full, np.minimum(limit, np.maximum(2 - 2 * worst, 0.0)), limit)
    return held[0], held[1], held[2], limit


def search_cell(cell: Cell, q: np.ndarray, q_id: np.ndarray, limit: np.ndarray, probes: list[np.ndarray], k: int, epsilon: float = 2.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of its probed lists in the cell: query index, id, cosine."""
    uq = unit(q)
    rq = uq @ cell.turn
    owner = np.repeat(np.arange(len(q)), [len(x) for x in probes])
    probed = np.concatenate(probes) if len(probes) else np.zeros(0, np.int64)
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    limit = limit.astype(float).copy()
    for number, a, b in zip(cell.numbers, cell.begins, cell.begins[1:]):
        who = owner[probed == number]
        if not len(who):
            continue
        i, ident, score, lowered = scan(uq[who], rq[who], q_id[who], limit[who], cell.units[a:b], cell.turned[a:b], cell.ids[a:b], k, epsilon=epsilon)
        limit[who] = lowered
        found = [np.concatenate(x) for x in zip(found, (who[i], ident, score))]
    top = best(found[0], found[2], found[1], k)
    return tuple(x[top] for x in found)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, lists: int | None = None, probes: int | None = None, sample: int = 8192, epsilon: float = 2.1, recall: float = 0.98) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) for the rows whose id is divisible by `every`.

    Shorter vectors count as having zeros up to the longest's length.  Rows
    without an id, without a vector, with a null or non-finite component or of
    length zero take no part; repeated rows count once, and of one id's different
    vectors the least, component by component; rows of the query's own id are no
    candidates.  Every query has k rows if there are so many candidates, else all.
    Scores are cosines of the vectors, each divided by its length first; equal ones
    rank by id, and parallel vectors of different lengths tie up to the rounding of
    that division.  Further columns are ignored.  An empty table gives no rows.
    Lists default to half the square root of the number of candidates (16 to 4096),
    probes to what the sample's recall asks for.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).where(F.exists("v", lambda x: x != 0))
    candidates = cut(first_of_equals(rows, F.col("v"), k).select("vec_id", "v"))
    facts = candidates.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).collect()[0]
    number, width = facts["n"], max(1, facts["width"] or 1)
    lists = lists or int(min(4096, max(16, round(number**0.5 / 2))))
    size = min(max(sample, 16 * lists), max(1024, NUMBERS // width))
    drawn = sampled(candidates, size, number, F.col("vec_id")).toArrow().sort_by("vec_id")
    units = unit(matrix(drawn.column("v"), width)) if drawn.num_rows else np.zeros((0, width))
    centres = centroids(units, lists) if len(units) else np.zeros((1, width))
    needed, middle = measured_probes(units, centres, k, recall) if len(units) else (np.ones((1, 2), np.int64), np.zeros(1))
    needed = np.minimum(len(centres), np.full_like(needed, probes) if probes else needed)
    ids = drawn.column("vec_id").to_numpy() if drawn.num_rows else np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((centres, rotation(width), units, ids))  # lists and sample rows times width numbers

    def place(batches):
        for batch in batches:
            of, close = nearest_centres(unit(matrix(batch.column("v"), width)), shared.value[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("vec_id", "v")), pa.array(of.astype(np.int32)), pa.array(close)], names=["vec_id", "v", "list", "close"])

    placed = candidates.mapInArrow(place, "vec_id long, v array<double>, list int, close double")
    sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.min("close").alias("farthest")).collect()  # one row a list
    count, farthest = np.zeros(len(centres), np.int64), np.ones(len(centres))
    for r in sizes:
        count[r["list"]], farthest[r["list"]] = r["n"], r["farthest"]
    begin = np.cumsum(count) - count
    cells = max(partitions(spark), -(-number // CELL))
    stretch = max(1, -(-number // cells))
    line = spark.createDataFrame([(n, int(begin[n]), int(count[n])) for n in range(len(centres))], "list int, begin long, n long")
    at = F.col("begin") + F.pmod(F.xxhash64("vec_id"), F.col("n"))
    stored = placed.join(F.broadcast(line), "list").select(F.floor(at / stretch).cast("int").alias("cell"), F.lit(0).alias("kind"), F.col("list").alias("place"), "vec_id", "v", F.lit(0.0).alias("worst"), F.array().cast("array<int>").alias("lists"))
    radius = np.arccos(np.clip(farthest, -1, 1))

    def started(batches):
        """Queries with their best rows of the sample."""
        for batch in batches:
            own = batch.column("vec_id").to_numpy()
            i, ident, score, worst = best_of_sample(unit(matrix(batch.column("v"), width)), own, *shared.value[2:], k)
            ends = pa.array(np.searchsorted(i, np.arange(len(own) + 1)), pa.int32())
            near = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(ident), pa.array(score)], names=["vec_id", "score"]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(worst), near], names=["vec_id", "v", "worst", "near"])

    def send(batches):
        """Rows of queries, one a cell, with the cell's lists among those that the query probes."""
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                close = unit(matrix(part.column("v"), width)) @ shared.value[0].T
                top = np.argsort(-close, axis=1, kind="stable")
                sorted_close = np.take_along_axis(close, top, axis=1)
                own = top[:, 0]
                enough = needed[own, (sorted_close[:, 0] >= middle[own]).astype(int)]
                # On until k candidates beside the query itself are there.
                held = np.cumsum(count[top], axis=1) - count[top]
                probed = (np.arange(len(centres))[None, :] < enough[:, None]) | (held < k + 1)
                worst = part.column("worst").to_numpy()
                angle = np.arccos(np.clip(sorted_close, -1, 1)) - radius[top]
                who, nth = np.nonzero(probed & (angle <= np.arccos(np.clip(worst, -1, 1))[:, None] + 1e-6) & (count[top] > 0))
                lists_of = top[who, nth]
                low, high = begin[lists_of] // stretch, (begin[lists_of] + count[lists_of] - 1) // stretch
                times = high - low + 1
                who, lists_of = np.repeat(who, times), np.repeat(lists_of, times)
                cell = np.repeat(low, times) + np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((lists_of, cell, who))
                who, lists_of, cell = who[order], lists_of[order], cell[order]
                new = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
                rows_of = pa.array(who[new])
                ints = pa.ListArray.from_arrays(pa.array(np.append(new, len(who)), pa.int32()), pa.array(lists_of.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[new].astype(np.int32)), pa.array(np.ones(len(new), np.int32)), pa.array(np.zeros(len(new), np.int32)), *(part.column(x).take(rows_of) for x in ("vec_id", "v", "worst")), ints],
                    names=["cell", "kind", "place", "vec_id", "v", "worst", "lists"],
                )

    def prepare(table: pa.Table) -> Cell:
        return Cell(matrix(table.column("v"), width), table.column("vec_id").to_numpy(), table.column("place").to_numpy(), shared.value[1])

    def search(cell: Cell, table: pa.Table) -> pa.RecordBatch:
        q_id, worst = table.column("vec_id").to_numpy(), table.column("worst").to_numpy()
        limit = np.where(worst > -2, np.maximum(2 - 2 * worst, 0.0), np.inf)
        probed = table.column("lists").combine_chunks()
        bounds = np.cumsum(probed.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        i, ident, score = search_cell(cell, matrix(table.column("v"), width), q_id, limit, np.split(probed.flatten().to_numpy(), bounds), k, epsilon)
        return pa.RecordBatch.from_arrays([pa.array(q_id[i]), pa.array(ident), pa.array(score)], names=["query_id", "vec_id", "score"])

    asked = cut(rows.where(F.col("vec_id") % every == 0).mapInArrow(started, "vec_id long, v array<double>, worst double, near array<struct<vec_id: long, score: double>>"))
    sent = asked.select("vec_id", "v", "worst").mapInArrow(send, "cell int, kind int, place int, vec_id long, v array<double>, worst double, lists array<int>")
    found = meet(stored.unionByName(sent), cells, prepare, search, "query_id long, vec_id long, score double")
    near = asked.select(F.col("vec_id").alias("query_id"), F.inline("near"))
    both = found.unionByName(near).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return ranked(both, k)
