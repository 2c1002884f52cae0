"""Best-fit packing with vector capacities.

A sequence (bin) has three capacities: tokens, number of pieces and attention
cost (the sum of squared piece lengths).  Pieces are taken from long to short;
among the open bins that can take a piece under every constraint one is chosen
either by the least residual norm (what is left after placing it, each
dimension relative to its capacity and weighted) or by the largest weighted
dot product of the piece's demand and the bin's residual.

Tokens are a hard capacity, and so are limits that the caller gives.  Without
such limits the other two are those of an even split: the shard's pieces and
attention cost over the fewest bins that its tokens allow, times `SLACK`.  They
bind, so that no sequence gathers hundreds of scraps while others hold two
documents; only a piece that no open bin can take under them is placed by its
tokens alone, and a shard that would still need more sequences than without the
even split is packed without it.

Pieces are dealt at random into shards of about `SHARD` pieces; each shard packs
on its own, so no task holds more than that, and the loss is at most about one
part-filled bin per shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .tokens import default_tokenizer, tokenizer

SHARD = 8192
#: How far a bin may be above an even split.
SLACK = 1.25


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: all full, but for the first perhaps."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((a, capacity) for a in range(head, n, capacity))]


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with keep_ids, the ids themselves.

    Null texts are empty: one piece with the end id alone.  Repeated rows give
    repeated pieces.
    """
    path = path or default_tokenizer()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path)
        row, out, ids_out = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = np.array([*bpe.encode(text or ""), end_id], "<u4")
            for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                part = ids[start : start + length]
                row.append(i)
                out.append((k, start, length, zlib.crc32(part.tobytes())))
                if keep_ids:
                    ids_out.append(part.astype(np.int32))
        table = np.array(out, np.int64).reshape(-1, 4)
        arrays = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, k]) for k in (1, 2, 3))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def even_limits(lengths: np.ndarray, capacity: int) -> tuple[float, float]:
    """Pieces and attention cost of a bin in an even split over the fewest bins, times SLACK.

    The cost is that of what shares bins: full pieces have theirs alone.
    """
    shared = lengths[lengths < capacity].astype(float)
    if not len(shared):
        return 1.0, float(capacity) ** 2
    bins = max(1.0, np.ceil(shared.sum() / capacity))
    return max(1.0, np.ceil(SLACK * len(shared) / bins)), SLACK * np.square(shared).sum() / bins


def vector_best_fit(
    lengths: np.ndarray, capacity: int, most_pieces: float, most_attention: float, weights: tuple[float, float, float] = (1.0, 0.02, 0.02), rule: str = "residual_norm", even: tuple[float, float] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset, and whether every constraint held, of each piece; lengths must be sorted from long to short.

    even: limits of pieces and attention cost that give way where no open bin has room under them.
    """
    n = len(lengths)
    bins, offsets, within = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    top = np.array([capacity, most_pieces, most_attention], float)
    soft = np.minimum(top, np.array([capacity, *(even or (most_pieces, most_attention))], float))
    weight = np.sqrt(np.array(weights))
    # What is left in open bins; closed ones are swapped out.
    free = np.zeros((1024, 3))
    number = np.zeros(1024, np.int64)
    count, used, least = 0, 0, int(lengths[-1]) if n else 0
    yields = top - soft
    for i, length in enumerate(lengths.tolist()):
        demand = np.array([length, 1.0, float(length) * length])
        best = -1
        if count:
            ok = (free[:count] >= demand).all(axis=1)
            if ok.any():
                left = free[:count] - yields - demand
                every = ok & (left >= 0).all(axis=1)
                within[i] = bool(every.any())
                score = -np.square(left / soft * weight).sum(axis=1) if rule == "residual_norm" else ((left + demand) / soft * weight) @ (demand / soft * weight)
                score[~(every if within[i] else ok)] = -np.inf
                best = int(np.argmax(score))
        if best < 0:
            if count == len(free):
                free, number = np.concatenate([free, free * 0]), np.concatenate([number, number * 0])
            best, count, used = count, count + 1, used + 1
            free[best], number[best] = top, used - 1
        bins[i], offsets[i] = number[best], capacity - free[best, 0]
        free[best] -= demand
        if free[best, 0] < least or free[best, 1] < 1 or free[best, 2] < float(least) * least:
            count -= 1
            free[best], number[best] = free[count], number[count]
    return bins, offsets, within


def pack(parts: DataFrame, capacity: int = 1024, most_pieces: int | None = None, most_attention: float | None = None, rule: str = "residual_norm", shard: int = SHARD) -> DataFrame:
    """parts (length from 0 to capacity, and any columns) with sequence_id, offset and within_limits.

    Limits that are given hold in every sequence of more than one piece; those
    left out are the shard's even split, which gives way (within_limits is then
    false) where no sequence has room or where it would cost a sequence.  Ties in length go by row, ties in score
    to the first open bin.  Columns of those three names are replaced.  Repeated
    rows are pieces of their own.  An empty table packs to an empty one.
    """
    parts = parts.drop("sequence_id", "offset", "within_limits")
    numbered = cut(parts.withColumn("_row", F.monotonically_increasing_id()))  # fixed once written
    shards = max(1, -(-numbered.count() // shard))
    dealt = numbered.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(shards)).alias("_shard"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((group["_row"].to_numpy(), -group["length"].to_numpy()))
        group = group.iloc[order]
        lengths = group["length"].to_numpy()
        pieces_, attention = even_limits(lengths, capacity)
        hard = (most_pieces or capacity, most_attention or float(capacity) ** 2)
        bins, offsets, within = vector_best_fit(lengths, capacity, *hard, rule=rule, even=(most_pieces or pieces_, most_attention or attention))
        if bins.max() * capacity >= lengths.sum():  # perhaps not the fewest: never more than without the even split
            others = vector_best_fit(lengths, capacity, *hard, rule=rule)
            if others[0].max() < bins.max():
                bins, offsets = others[:2]
                within = np.zeros(len(bins), bool)
        return pd.DataFrame({"_row": group["_row"].to_numpy(), "sequence_id": (group["_shard"].to_numpy().astype(np.int64) << 24) + bins, "offset": offsets, "within_limits": within})

    placed = dealt.groupBy("_shard").applyInPandas(run, "_row long, sequence_id long, offset long, within_limits boolean")
    return numbered.join(placed, "_row").drop("_row")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, keep_ids: bool = False, **limits) -> DataFrame:
    """Tokenize, cut and pack; one row per piece.

    Null and empty texts are one piece with the end id; long texts are encoded
    whole.  Repeated rows and null ids are packed like any other.  Columns other
    than doc_id and text are ignored.  An empty table gives no rows.
    """
    return pack(pieces(docs, capacity, end_id, path, keep_ids), capacity, **limits)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed token arrays (of pieces that kept their ids)."""
    part = F.struct("offset", "ids")
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
