"""What both vector searches need: usable rows, distinct vectors, cells of candidates that queries pass, best-k merging.

A cell is a bounded part of the candidates; its number is its shuffle partition.
Each query is sent once to each cell that it needs, so the shuffle is the
candidates once and the queries times the cells, and a task holds one cell and a
thousand queries at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a cell at most, about (64 numbers each: 32 MB), and queries at a time.
CELL = 1 << 16
QUERIES = 1024


def usable(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(vec_id long, v array<double>) of rows with an id, a vector, and finite components only.

    Repeated rows count once.  Of rows with one id and different vectors the
    least vector counts, compared component by component.  Other columns are
    dropped.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite).groupBy("vec_id").agg(F.min("v").alias("v"))


def first_of_equals(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """Of rows with equal vectors (an id has one row), the k + 1 smallest ids.

    No query can have another of them among its k best, ties going to smaller
    ids and one id being its own.  Each map task drops the rest before the
    shuffle, so a vector that a third of all rows share costs k + 1 rows a task.
    """
    order = Window.partitionBy(key).orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column, with zeros up to the width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def meet(rows: DataFrame, cells: int, prepare: Callable[[pa.Table], object], search: Callable[[object, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows (cell, kind, place, ...): each cell's candidates (kind 0, by place) meet its queries (kind 1).

    `prepare` gets a cell's candidates once, `search` what that made and up to
    `QUERIES` queries at a time.
    """

    def run(batches):
        cell, held, ready = None, [], None
        for batch in batches:
            at, kind = (batch.column(x).to_numpy() for x in ("cell", "kind"))
            edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if at[a] != cell:
                    cell, held, ready = at[a], [], None
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    ready, held = prepare(pa.Table.from_batches(held)), []
                if ready is not None:
                    for c in range(a, b, QUERIES):
                        yield search(ready, pa.Table.from_batches([batch.slice(c, min(QUERIES, b - c))]))

    return rows.repartitionById(cells, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind", "place").mapInArrow(run, schema)


def best(query: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k highest scores, ties to the smaller id; by query."""
    order = np.lexsort((ident, -score, query))
    q = query[order]
    first = np.flatnonzero(np.diff(q, prepend=-1)) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) -> query_id, rank, vec_id, score; k rows a query at most."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    rows = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
