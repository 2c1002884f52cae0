"""SimHash near-duplicates, with pivot distance tables as the filter on pairs.

1. Fingerprints: 64-bit majority of the XXH64 of a text's 3-word shingles.
2. Equal fingerprints collapse to one node, so copies never meet as pairs.
3. Each node carries its Hamming distances to `PIVOTS` reference fingerprints.
   By the triangle inequality, two nodes within distance r differ by at most r
   in every one of these coordinates.
4. Nodes meet in cells: of the four 16-bit blocks, a pair within distance 2
   agrees on two at least, so six cells of 32 bits lose no pair.  Inside a cell
   nodes are sorted by their first coordinate and compared only while it differs
   by r at most; a pair whose largest coordinate difference exceeds r is
   discarded; survivors are verified by their real distance.
5. A cell hands on a spanning forest of its links, never all of them, and
   connected components are formed over nodes.

Cells beyond `CELL` nodes are split into chunks that meet pairwise, so no task
has to hold a cell of unbounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, masked, mix, partitions
from .components import connected_components

PIVOTS = 32
CELL = 4096
_BYTES = np.uint64(0x0101010101010101)


def _majority(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per group of hashes (starts; none empty) the bits set in over half of them."""
    ends = np.append(starts[1:], len(h))
    counts = ends - starts
    # Byte-wise sums can't overflow over 255 values.
    steps = (counts + 254) // 255
    first = np.concatenate([[0], np.cumsum(steps)])[:-1]
    cuts = np.repeat(starts, steps) + 255 * (np.arange(steps.sum()) - np.repeat(first, steps))
    out = np.zeros(len(starts), np.uint64)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & _BYTES, cuts).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        for byte in range(8):
            out |= (2 * total[:, byte] > counts).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def text_fingerprints(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """uint64 per text; A-Z lower-cased; no words: 0; fewer than a shingle: the whole sequence."""
    digest, all_hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or "").encode().lower().split()
        if not words:
            sizes.append(0)
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            all_hashes.append(digest(joined, 42))
            sizes.append(1)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
        all_hashes.extend([digest(joined[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist())])
        sizes.append(len(begins))
    sizes = np.array(sizes, np.int64)
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        starts = np.concatenate([[0], np.cumsum(sizes[some])])[:-1]
        out[some] = _majority(np.array(all_hashes, np.uint64), starts)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long): fp holds the 64 bits."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = text_fingerprints(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pivot_table(fp: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Distances (rows by n, uint8) from each fingerprint to each reference."""
    return np.bitwise_count(fp[:, None] ^ pivots(n)[None, :])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index reached from each of n indices."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_cells(cell: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, n_pivots: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Links (as a forest) among equal-cell fingerprints; cells are contiguous.

    side < 0: every pair counts; else only pairs of different sides do, as those
    of one side meet in a cell of their own.
    """
    table = pivot_table(fp, n_pivots)
    order = np.lexsort((table[:, 0], cell))
    cell, side, fp, table = cell[order], side[order], fp[order], table[order].astype(np.int16)
    left, right = [], []
    i = np.arange(len(fp))
    lag = 0
    while len(i):
        lag += 1
        i = i[i + lag < len(fp)]
        i = i[(cell[i] == cell[i + lag]) & (table[i + lag, 0] - table[i, 0] <= radius)]
        j = i + lag
        open_ = (side[i] < 0) | (side[i] != side[j])
        a, b = i[open_], j[open_]
        for c in range(1, n_pivots):
            if not len(a):
                break
            near = np.abs(table[a, c] - table[b, c]) <= radius
            a, b = a[near], b[near]
        if len(a):
            real = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            a, b = a[real], b[real]
            if len(a):
                left.append(a)
                right.append(b)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    root = _forest(np.concatenate(left), np.concatenate(right), len(fp))
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """nodes (fp, distinct) -> edges (a, b) that connect what lies within the radius (2 at most)."""
    if not 0 <= radius <= 2:
        raise ValueError("the cells are made for a radius of 2 at most")
    block = [F.shiftrightunsigned(F.col("fp"), 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(x, y) for x in range(4) for y in range(x)]
    keys = F.array(*[F.lit(n << 32) + F.shiftleft(block[x], 16) + block[y] for n, (x, y) in enumerate(pairs)])
    met = nodes.select("fp", F.explode(keys).alias("cell"))
    large = met.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("chunks"))
    met = met.join(large, "cell", "left")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = met.withColumn("chunk", F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(chunk))
    met = met.withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    met = met.select("fp", "cell", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), F.when(F.col("chunk") == F.col("other"), F.lit(-1)).otherwise(F.col("chunk")).alias("side"))
    # A chunk's own pairs meet where lo = hi; elsewhere only pairs across chunks count.
    spread = met.repartition(partitions(nodes.sparkSession), "cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "fp")

    def run(batches):
        held: list[pa.Table] = []
        rows = 0

        def flush(table: pa.Table):
            cols = [table.column(k).to_numpy() for k in ("cell", "lo", "hi", "side", "fp")]
            starts = np.zeros(len(cols[0]), bool)
            starts[:1] = True
            for k in cols[:3]:
                starts[1:] |= k[1:] != k[:-1]
            a, b = link_cells(np.cumsum(starts), cols[3], cols[4].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < 100_000:
                continue
            table = pa.concat_tables(held)
            last = [table.column(k)[rows - 1].as_py() for k in ("cell", "lo", "hi")]
            same = np.ones(rows, bool)
            for k, v in zip(("cell", "lo", "hi"), last):
                same &= table.column(k).to_numpy() == v
            whole = int(np.argmax(same))
            if whole:
                yield flush(table.slice(0, whole))
            held, rows = [table.slice(whole)], rows - whole
        if rows:
            yield flush(pa.concat_tables(held))

    return spread.mapInArrow(run, "a long, b long")


def groups(rows: DataFrame, radius: int = 2) -> DataFrame:
    """rows (doc_id, fp) -> (fp, root, least): each fingerprint's component and its smallest id."""
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes.select("fp"), radius))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most `radius`
    differing bits.  Null and empty texts have fingerprint zero and link like
    any other.  Rows with a null id get a component but never name one, unless
    all its rows have null ids (then null).  Repeated rows stay rows.  A shingle set
    in exactly half of the hashes leaves the bit 0.  Long texts count whole; further
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs))
    named = groups(rows, radius)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id (null ids last).

    Of several rows with that id, the one of the least hash over all columns; of
    equal rows, one.  Null and empty texts are one group with fingerprint zero;
    long texts are read whole.  Any columns may be there.  An empty table gives
    an empty one.  Texts are read twice and never shuffled while the keys of the
    rows that go are fewer than the session broadcasts; beyond that, once.
    """
    plain = masked(docs, "doc_id", "text")
    marked = plain.withColumn("_row", F.xxhash64(*plain.columns))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = text_fingerprints(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fp.view(np.int64))], names=["doc_id", "row", "fp"])

    narrow = marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_row").alias("row"), "text")
    rows = cut(map_arrow(narrow, run, "doc_id long, row long, fp long"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("least")
    first = rows.groupBy(F.col("fp").alias("of")).agg(least)
    chosen = groups(rows, radius).drop("least").join(first, F.col("fp") == F.col("of")).groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.row")
    keys = rows.groupBy("doc_id", "row").agg(F.count("*").alias("n"))
    stays = chosen.select(F.col("doc_id").alias("id"), F.col("row").alias("key"), F.lit(True).alias("stays"))
    known = keys.join(stays, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("key")), "left")
    # What goes, and rows that stay but are there several times.
    special = cut(known.where("stays IS NULL OR n > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_key"), F.coalesce("stays", F.lit(False)).alias("_several")))
    size = docs.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    small = special.count() * 64 <= int(size.rstrip("bB")) if size.rstrip("bB").lstrip("-").isdigit() else False
    hint = F.broadcast if small else (lambda x: x)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key"))
    kept = marked.join(hint(special), same, "left_anti").select(*plain.columns)
    several = special.where("_several")
    if not several.isEmpty():
        kept = kept.unionByName(marked.join(hint(several), same, "left_semi").dropDuplicates(["doc_id", "_row"]).select(*plain.columns))
    return kept.toDF(*docs.columns)
