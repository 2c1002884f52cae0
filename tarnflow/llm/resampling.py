"""Importance resampling towards a target: hashed word runs, one weight for all copies of a text.

Identical texts are collapsed first, by grouping full texts; features are made and
weighed once a distinct text, its counts multiplied by its copies.  Weights go back
to documents by the text's SHA-256, so texts are shuffled once, and only then does
each document get its own noise.  Ranks need no global sort: a histogram over the
integer scores (their range is bounded) gives each score's place, and within a score
documents are numbered by id.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, encode, slices
from .exact import lowered

BUCKETS = 10_000
LEAST_WORDS = 20
_WORD = np.ones(256, bool)  # of lowered text: digits, a-z and all beyond ASCII
_WORD[:128] = False
_WORD[48:58] = _WORD[97:123] = True


def _after_zeros() -> list[np.ndarray]:
    """For 1, 2, 4 .. 2^30 zero bytes: what a CRC-32 register becomes, as four tables of its bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    one = lambda c: (c >> np.uint32(8)) ^ byte[c & np.uint32(255)]
    values = np.arange(256, dtype=np.uint32)
    tables = [np.stack([one(values << np.uint32(8 * k)) for k in range(4)])]
    for _ in range(30):
        last = tables[-1]
        tables.append(np.stack([_apply(last, last[k]) for k in range(4)]))
    return tables


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return table[0][c & low] ^ table[1][(c >> np.uint32(8)) & low] ^ table[2][(c >> np.uint32(16)) & low] ^ table[3][c >> np.uint32(24)]


_ZEROS = _after_zeros()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of x + y from those of x and of y and the length of y."""
    c, k = first.copy(), 0
    while (length >> k).any():
        own = np.flatnonzero((length >> k) & 1)
        c[own] = _apply(_ZEROS[k], c[own])
        k += 1
    return c ^ second


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, text by text, and each text's number of words."""
    n = len(offsets) - 1
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = inside[heads]  # a text's first character ends the former text's last word
    begin = np.flatnonzero(starts[:-1])
    text = np.searchsorted(offsets, begin, side="right") - 1
    words = np.bincount(text, minlength=n)
    size = np.add.reduceat(inside[:-1].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    ends = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside[:-1]]))])
    codes, distinct = encode(flat)
    known = distinct.to_pylist()
    alone = np.fromiter((zlib.crc32(w) for w in known), np.uint32, len(known))
    spaced = np.fromiter((zlib.crc32(w + b" ") for w in known), np.uint32, len(known))
    pair = np.flatnonzero(text[1:] == text[:-1])
    second = codes[pair + 1]
    both = joined_crc(spaced[codes[pair]], alone[second], size[pair + 1])
    features = words + np.maximum(words - 1, 0)
    place = np.cumsum(features) - features
    nth = np.arange(len(begin)) - np.repeat(np.cumsum(words) - words, words)
    out = np.zeros(int(features.sum()), np.uint16)
    out[place[text] + nth] = alone[codes] % BUCKETS
    out[(place + words)[text[pair]] + nth[pair]] = both % BUCKETS
    return out, words


def collapsed(texts: DataFrame) -> DataFrame:
    """text, copies, key (SHA-256): identical texts once; a null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return texts.groupBy(text.alias("text")).agg(F.count("*").alias("copies")).withColumn("key", _key(F.col("text")))


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def features(texts: DataFrame) -> DataFrame:
    """key, copies, n_words, buckets (unsigned 16-bit numbers, one a feature) of collapsed texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                buckets, words = word_runs(*lowered(part.column("text")))
                ends = 2 * np.cumsum(words + np.maximum(words - 1, 0))
                raw = buckets.astype("<u2").tobytes()
                packed = pa.array([raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("copies"), pa.array(words), packed], names=["key", "copies", "n_words", "buckets"])

    return texts.mapInArrow(run, "key binary, copies long, n_words long, buckets binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the batch's features, and how many each row has."""
    column = batch.column("buckets").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), "<u2"), np.diff(offsets) // 2


def bucket_counts(made: DataFrame) -> np.ndarray:
    """Features in each bucket, copies counted; a task sends BUCKETS rows at most."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            buckets, each = _flat(batch)
            copies = np.repeat(batch.column("copies").to_numpy(), each)
            for k in np.unique(copies):
                total += k * np.bincount(buckets[copies == k], minlength=BUCKETS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in made.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the corpus."""
    s, t = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + BUCKETS) / ((a + 1.0) * (t + BUCKETS)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(made: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_words, n_features, weight: the floored mean of gains over a text's features."""

    def run(batches):
        for batch in batches:
            buckets, each = _flat(batch)
            sums = np.zeros(len(each), np.int64)
            full = np.flatnonzero(each)
            if len(full):
                sums[full] = np.add.reduceat(gain[buckets], (np.cumsum(each) - each)[full])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), pa.array(each), pa.array(sums // np.maximum(each, 1))], names=["key", "n_words", "n_features", "weight"])

    return made.mapInArrow(run, "key binary, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel) of the id's hash."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = LEAST_WORDS, seed: int = 7) -> DataFrame:
    """Every row's doc_id, n_features, weight, score, rank (null where it isn't drawn).

    Of the N rows with `least_words` words or more, floor(percent * N / 100) are
    drawn by the highest scores, ties to the smaller doc_id (a null id last; rows
    of one id and score in any order).  Null and empty texts have no features and
    weight 0.  An empty target smooths to equal shares; an empty table gives no
    rows.  Further columns are ignored, on both sides; repeated rows count and come
    out as often as they are there.  Texts of any length are taken whole.
    """
    spark = docs.sparkSession
    made = cut(features(collapsed(docs)))
    gain = gains(bucket_counts(made), bucket_counts(features(collapsed(target))))
    rows = docs.select("doc_id", _key(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    scored = cut(rows.join(weigh(made, gain), "key").select("doc_id", "n_words", "n_features", "weight", score.alias("score")))
    able = F.col("n_words") >= least_words
    # Scores are integers between about -100,000 and 130,000: logarithms of 64-bit counts, and of 2^-33.
    seen = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    taken = percent * int(seen["n"].sum()) // 100
    seen["before"] = seen["n"].cumsum() - seen["n"]
    drawn = seen[seen["before"] < taken]
    places = spark.createDataFrame(pd.DataFrame({"score": drawn["score"].astype("int64"), "before": drawn["before"].astype("int64")}), "score long, before long")
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    near = scored.where(able).join(F.broadcast(places), "score").withColumn("rank", F.col("before") + nth)
    rank = F.when(F.col("rank") <= taken, F.col("rank"))
    columns = ("doc_id", "n_features", "weight", "score")
    last = int(drawn["score"].min()) if len(drawn) else None
    rest = scored.where(~able | (F.col("score") < last)) if last is not None else scored
    return near.select(*columns, rank.alias("rank")).unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
