"""Helpers that the corpus operators share.

Texts are split on the six ASCII white-space characters everywhere, so one
vectorised splitter serves all of them.  Nothing here holds more than a slice
of a few megabytes of text at a time.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that Python code works on at once.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local session gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tarnflow-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written once to the shared folder, lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which its owner sets in proportion to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n (null value: the empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most about `limit` text bytes; a longer single text stays whole."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(piece)) + 1
    bounds = [0, *edges.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in one flat array, and per text the offsets into it.

    A word is a maximal run of characters other than space and U+0009..U+000D.
    Null texts have no words.  `lower` maps A-Z only.
    """
    texts = pc.fill_null(texts, "")
    # The cast keeps a slice's first offset, and ascii_lower reads beside such an array's bytes: copy first.
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.zeros(len(texts) + 1, np.int64)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    np.cumsum(lengths, out=offsets[1:])
    keep = pc.greater(pc.binary_length(flat), 0)
    kept = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(keep.to_numpy(zero_copy_only=False), out=kept[1:])
    return flat.filter(keep), kept[offsets]


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Local codes of the words, and the distinct words."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each string's UTF-8 bytes, as uint64."""
    f = xxhash.xxh64_intdigest
    return np.fromiter((f(x, seed) for x in values.to_pylist()), np.uint64, len(values))


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (shift-multiply rounds)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """mapInArrow, where f turns one slice (RecordBatch) into one RecordBatch or none."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = f(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def masked(docs: DataFrame, *kept: str) -> DataFrame:
    """docs with every column but the kept ones under a neutral name, so that none can clash with ours.

    `toDF(*docs.columns)` undoes it.
    """
    return docs.toDF(*[c if c in kept else f"_c{i}" for i, c in enumerate(docs.columns)])


def sampled(df: DataFrame, size: int, rows: int, key: Column) -> DataFrame:
    """About `size` of df's `rows` rows, chosen by a hash of the key: the same ones in every run and layout.

    A sort with a limit would send that limit from each partition; this sends
    the sample alone.  With no more rows than that, all of them.
    """
    if rows <= size:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.lit(int((1 << 30) * size / rows)))


def string_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string (none null), for all of them at once.

    Bytes become pseudo-random words, weighted by powers of an odd constant;
    differences of prefix sums, brought back to power zero, are the strings'
    values.  Stable over processes and machines.
    """
    values = values.cast(pa.large_binary())
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(values.buffers()[1], np.int64, count=n + 1, offset=8 * values.offset)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    symbol = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    power = np.full(len(raw) + 1, base, np.uint64)
    back = np.full(len(raw) + 1, inverse, np.uint64)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(symbol[raw] * power[:-1], out=sums[1:])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]] + np.diff(offsets).astype(np.uint64))
