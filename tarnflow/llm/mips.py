"""Exact top-k inner products of integer vectors: norm order, SVD rotation, Cauchy-Schwarz bounds.

The right singular vectors of all candidates (from their Gram matrix, summed
over partitions) rotate every vector, so that the first coordinates carry most
of an inner product.  Candidates are taken from long to short, in blocks:

* a query is done with a block once |q| * (longest left) is below its k-th best;
* after some coordinates the rest is at most |rest of q| * |rest of v|; a pair
  whose partial sum plus that bound is below the k-th best is dropped;
* the others get their exact integer product.

Bounds are compared with a slack that covers rounding, so nothing is lost.
About `HEAD` of the longest candidates, a bounded number, are seen first by all
queries: their k-th best starts the pruning.  The others are dealt into cells by
length (`BANDS` bands by quantiles, each split by a hash of the id as often as its
rows ask); a query goes to the cells whose longest vector it can still use, by
Cauchy-Schwarz, and meets each cell's candidates from long to short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, sampled
from .vectors import CELL, best, first_of_equals, matrix, meet, ranked, usable

HEAD = 4096
BANDS = 16
#: Below this share of pairs left, pairs are handled one by one; else block by block.
SPARSE = 0.01
_LEAST = np.iinfo(np.int64).min


class Candidates:
    """Vectors from long to short, rotated, with the lengths of what is left after some coordinates."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, rotation: np.ndarray):
        order = np.lexsort((ids, -np.linalg.norm(v, axis=1)))
        self.v, self.ids, self.rotation = v[order], ids[order], rotation
        dims = v.shape[1]
        self.depths = sorted({max(1, dims // 8), max(1, dims // 4), max(1, dims // 2)} - {dims})
        self.turned, self.norm, self.tails = self.turn(self.v)
        self.largest = float(np.abs(v).max(initial=0))
        self.as_double = self.v.astype(float)

    def turn(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        r = x @ self.rotation
        return r, np.linalg.norm(r, axis=1), {d: np.sqrt(np.square(r[:, d:]).sum(axis=1)) for d in self.depths}


def search_block(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, those: Candidates, k: int, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of the candidates (those that can still count): query index, id, score.

    floor: scores below it can't count.
    """
    rq, q_norm, q_tail = those.turn(q)
    v, v_id, rv, v_norm, v_tail, depths = those.v, those.ids, those.turned, those.norm, those.tails, those.depths
    # Integers below 2 ** 53 multiply and add exactly as doubles, in any order.
    exact = float(np.abs(q).max(initial=0)) * those.largest * q.shape[1] < 2.0**53
    as_double = (q.astype(float), those.as_double)
    held = [np.zeros(0, np.int64)] * 3
    limit = floor.astype(float)
    for a in range(0, len(v), step):
        own = slice(a, a + step)
        slack = 1e-9 * q_norm * v_norm[a] + 1e-6
        live = np.flatnonzero(q_norm * v_norm[a] + slack >= limit)
        if not len(live):
            break
        part, seen, keep = 0.0, 0, np.ones((len(live), len(v[own])), bool)
        for d in depths:
            part = part + rq[live, seen:d] @ rv[own, seen:d].T
            keep &= part + (slack[live][:, None] + q_tail[d][live][:, None] * v_tail[d][own][None, :]) >= limit[live][:, None]
            seen = d
            if np.count_nonzero(keep) < SPARSE * keep.size:
                break
        if exact and np.count_nonzero(keep) >= SPARSE * keep.size:
            score = as_double[0][live] @ as_double[1][own].T
            keep &= score >= limit[live][:, None]
            i, j = np.nonzero(keep)
            score, i, j = score[i, j].astype(np.int64), live[i], j + a
        else:
            i, j = np.nonzero(keep)
            i, j = live[i], j + a
            score = (q[i].astype(np.int64) * v[j].astype(np.int64)).sum(axis=1)
        fine = (q_id[i] != v_id[j]) & (score >= limit[i])
        held = [np.concatenate(x) for x in zip(held, (i[fine], v_id[j[fine]], score[fine]))]
        top = best(held[0], held[2], held[1], k)
        held = [x[top] for x in held]
        full = np.bincount(held[0], minlength=len(q)) == k
        worst = np.full(len(q), np.inf)
        np.minimum.at(worst, held[0], held[2].astype(float))
        limit = np.where(full, np.maximum(limit, worst), limit)
    return held[0], held[1], held[2]


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`.

    Components become floor(scale * x); shorter vectors count as having zeros
    up to the longest's length.  Rows without an id, without a vector or with a
    null or non-finite component take no part.  Repeated rows count once, and of
    one id's different vectors the least, component by component.  Rows of the
    query's own id are no candidates.  Equal scores rank by id.  Raises
    ValueError where a product could exceed 64 bits (width * largest ** 2 over
    2 ** 62).  Further columns are ignored.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = usable(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = cut(whole.withColumn("norm", length))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).collect()[0]
    width = max(1, facts["width"] or 1)
    if (facts["largest"] or 0) ** 2 * width > 1 << 62:
        raise ValueError("components are too large for 64-bit products")
    candidates = cut(first_of_equals(rows, F.col("v"), k))

    def gram(batches):
        total = np.zeros((width, width))
        for batch in batches:
            m = matrix(batch.column("v"), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "x"])

    cells = candidates.select("v").mapInArrow(gram, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # width ** 2 rows
    total = np.zeros(width * width)
    total[cells.column("at").to_numpy()] = cells.column("x").to_numpy()
    _, vectors_ = np.linalg.eigh(total.reshape(width, width))
    rotation = spark.sparkContext.broadcast(np.ascontiguousarray(vectors_[:, ::-1]))
    fractions = [n / BANDS for n in range(1, BANDS)]
    number = candidates.count()
    head_share = max(0.0, 1 - HEAD / max(1, number))
    edges = candidates.agg(F.percentile_approx("norm", F.lit([*fractions, head_share]), F.lit(10_000)).alias("x")).collect()[0]["x"] or [0.0] * BANDS
    edges, least = sorted(set(edges[:-1])), edges[-1]  # BANDS numbers at most
    long = candidates.where(F.col("norm") >= F.lit(least))
    longest = sampled(long, HEAD, long.count(), F.col("vec_id")).toArrow().sort_by([("norm", "descending"), ("vec_id", "ascending")])
    head = spark.sparkContext.broadcast((matrix(longest.column("v"), width, np.int64), longest.column("vec_id").to_numpy()))

    def first_look(batches):
        seen = Candidates(*head.value, rotation.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                q, _, score = search_block(matrix(part.column("v"), width, np.int64), part.column("vec_id").to_numpy(), np.full(part.num_rows, _LEAST), seen, k)
                low = np.full(part.num_rows, np.iinfo(np.int64).max)
                np.minimum.at(low, q, score)
                floor = np.where(np.bincount(q, minlength=part.num_rows) == k, low, _LEAST)
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("vec_id", "v", "norm")), pa.array(floor)], names=["vec_id", "v", "norm", "floor"])

    band = F.lit(0)
    for x in edges:
        band = band + F.when(F.col("norm") >= F.lit(x), 1).otherwise(0)
    banded = candidates.withColumn("band", band)
    facts = {r["band"]: r for r in banded.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}  # BANDS rows at most
    wanted = max(partitions(spark), -(-number // CELL))
    bands, cells = [], 0
    for n in sorted(facts):
        splits = max(1, round(wanted * facts[n]["n"] / max(1, number)))
        bands.append((n, facts[n]["top"], cells, splits))
        cells += splits
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cell, reached = F.lit(None).cast("int"), F.array().cast("array<int>")
    for n, top, begin, splits in bands:
        cell = F.when(F.col("band") == n, F.lit(begin) + F.pmod(F.xxhash64("vec_id"), F.lit(splits))).otherwise(cell)
        # The longest vector of the band, and a slack as in the search.
        bound = F.col("norm") * F.lit(top * (1 + 1e-9)) + F.lit(1e-6)
        reached = F.concat(reached, F.when(bound >= F.col("floor"), F.sequence(F.lit(begin), F.lit(begin + splits - 1))).otherwise(F.array().cast("array<int>")))
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", "norm").repartition(partitions(spark), "vec_id")
    asked = cut(queries.mapInArrow(first_look, "vec_id long, v array<long>, norm double, floor long"))
    columns = ["cell", "kind", "place", "vec_id", "v", "floor"]
    stored = banded.select(cell.cast("int").alias("cell"), F.lit(0).alias("kind"), (-F.col("norm")).alias("place"), "vec_id", "v", F.lit(0).cast("long").alias("floor"))
    sent = asked.select(F.explode(reached).alias("cell"), F.lit(1).alias("kind"), F.lit(0.0).alias("place"), "vec_id", "v", "floor")

    def prepare(table: pa.Table) -> Candidates:
        return Candidates(matrix(table.column("v"), width, np.int64), table.column("vec_id").to_numpy(), rotation.value)

    def search(those: Candidates, table: pa.Table) -> pa.RecordBatch:
        q_id = table.column("vec_id").to_numpy()
        i, ident, score = search_block(matrix(table.column("v"), width, np.int64), q_id, table.column("floor").to_numpy(), those, k)
        return pa.RecordBatch.from_arrays([pa.array(q_id[i]), pa.array(ident), pa.array(score)], names=["query_id", "vec_id", "score"])

    met = meet(stored.select(columns).unionByName(sent.select(columns)), cells, prepare, search, "query_id long, vec_id long, score long")
    return ranked(met, k)
