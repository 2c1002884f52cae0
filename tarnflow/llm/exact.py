"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of bytes b1 .. bn is the sum of (bi + 1) * B^(n - i), modulo two
primes below 2^31.  Those of two neighbouring chunks combine by length-shifted
arithmetic: hash(xy) = hash(x) * B^len(y) + hash(y).  So chunks are hashed in any
order and anywhere: within a task a text is a sum over its pieces, and the pieces
of a huge text are dealt over tasks, shifted each by the bytes after it, and summed.

Rows of equal fingerprint and length are then compared piece by piece: over all
rows of a group, each place must have one content.  That is a grouping by (group,
place, content), so a group of a third of all rows leaves each map task as one copy.
Texts whose fingerprint no other row has take no part in it: a bitmap of fixed size
tells which may.  Where contents differ under one fingerprint, texts are grouped whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, partitions

MODULI = (2147483647, 2147483629)
BASES = (1566083941, 1823492057)
#: Symbols summed before a modulus is taken: 2^8 of at most 2^8 * 2^31 stay below 2^53.
BLOCK = 1 << 8
#: Bytes of a piece, of the pieces hashed at once, and of a text whose pieces are dealt over tasks.
PIECE, AT_ONCE, HUGE = 1 << 16, 1 << 22, 8 << 20
#: Rows of a group from which on it is not dealt to one task.
LARGE = 1024
#: Bits of the map of fingerprints that more than one row may have: 8 MB.
BITS = 1 << 26
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def power(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    """base to each exponent, by squaring."""
    rest, out = exponents.astype(np.uint64), np.ones(len(exponents), np.uint64)
    b, m = np.uint64(base % modulus), np.uint64(modulus)
    while rest.any():
        out = np.where(rest & np.uint64(1), out * b % m, out)
        b, rest = b * b % m, rest >> np.uint64(1)
    return out


def combine(x: tuple[np.ndarray, int], y: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """(hash, length) of two neighbouring chunks -> those of both together."""
    shift = [int(power(b, np.array([y[1]]), m)[0]) for b, m in zip(BASES, MODULI)]
    return np.array([(int(h) * s + int(g)) % m for h, g, s, m in zip(x[0], y[0], shift, MODULI)], np.uint64), x[1] + y[1]


def piece_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[pieces, 2]: hash of data[begin:end] for each piece.

    Pieces are laid out in rows of BLOCK symbols, zeros before each (they add
    nothing); a row's hash is a product with the powers of the base, exact in double
    precision, and rows combine by the shift of those after them.
    """
    out = np.zeros((len(begin), 2), np.uint64)
    size = end - begin
    full = np.flatnonzero(size)
    if not len(full):
        return out
    rows = -(-size[full] // BLOCK)
    past = np.cumsum(rows) * BLOCK
    laid = np.zeros(int(past[-1]))
    for a, b, e, n in zip(begin[full].tolist(), end[full].tolist(), past.tolist(), size[full].tolist()):
        own = laid[e - n : e]
        own[:] = data[a:b]
        own += 1
    first = np.cumsum(rows) - rows
    after = np.repeat(first + rows - 1, rows) - np.arange(rows.sum())  # rows after this one in its piece
    for k, (b, m) in enumerate(zip(BASES, MODULI)):
        sums = (laid.reshape(-1, BLOCK) @ power(b, np.arange(BLOCK)[::-1], m).astype(float)).astype(np.uint64) % np.uint64(m)
        moved = sums * power(b, np.arange(int(rows.max())) * BLOCK, m)[after] % np.uint64(m)
        out[full, k] = np.add.reduceat(moved, first) % np.uint64(m)
    return out


def cut_up(offsets: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts: text, number within it, begin, end; an empty text has one empty piece."""
    count = np.maximum(1, -(-np.diff(offsets) // piece))
    text = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][text] + nth * piece
    return text, nth, begin, np.minimum(begin + piece, offsets[1:][text])


def fingerprints(data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """62-bit fingerprints of the texts data[offsets[i]:offsets[i + 1]], a few megabytes of pieces at a time."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64)
    text, _, begin, end = cut_up(offsets, piece)
    parts = np.zeros((len(text), 2), np.uint64)
    group = (end - offsets[0]) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(text)]
    for a, b in zip(edges, edges[1:]):
        parts[a:b] = piece_hashes(data, begin[a:b], end[a:b])
    first = np.flatnonzero(np.diff(text, prepend=-1))
    after = offsets[1:][text] - end
    sums = [np.add.reduceat(parts[:, k] * power(b, after, m) % np.uint64(m), first) % np.uint64(m) for k, (b, m) in enumerate(zip(BASES, MODULI))]
    return ((sums[0] << np.uint64(31)) | sums[1]).astype(np.int64)


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z lowered, and offsets into them; null texts are empty."""
    texts = pc.fill_null(texts, "")
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    data = texts.buffers()[2]
    return (_LOWER[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)), offsets


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


class Marks:
    """Fingerprints of documents, and the pieces of those that others may equal."""

    def __init__(self, docs: DataFrame, piece: int, huge: int, reduce: Callable[[np.ndarray], np.ndarray]):
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        text = F.coalesce(F.col("text"), F.lit(""))
        self.piece, self.reduce = piece, reduce
        longest = docs.agg(F.max(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
        self.parts = longest > huge  # else no scan looks for texts to be dealt out
        self.rows = docs.select("doc_id", text.alias("text")).where(F.octet_length(text) <= huge)
        size = F.octet_length("text").cast("long")
        long = docs.select("doc_id", _ascii_lower(text).alias("text")).where(F.octet_length(text) > huge)
        # Rows equal in id and text are one here: their pieces are the same.
        self.long = long.select("doc_id", size.alias("n"), F.xxhash64("text").alias("x"), "text")

    def facts(self) -> DataFrame:
        """doc_id, n (bytes), fp, sha (of the normalised text) of every row."""
        piece, reduce = self.piece, self.reduce

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = lowered(batch.column("text"))
            view = memoryview(data)
            sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets, offsets[1:])]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(reduce(fingerprints(data, offsets, piece))), pa.array(sha, pa.binary())], names=["doc_id", "n", "fp", "sha"])

        whole = map_arrow(self.rows, run, f"doc_id {self.kind}, n long, fp long, sha binary")
        if not self.parts:
            return whole
        long = self.long.withColumn("sha", F.unhex(F.sha2("text", 256))).drop("text")
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("x") == F.col("_x")) & (F.col("n") == F.col("_n"))
        return whole.unionByName(long.join(self._summed(), same).select("doc_id", "n", "fp", "sha"))

    def _pieces(self) -> DataFrame:
        """doc_id, n, x, at, piece (binary) of the huge texts."""
        bytes_, size = F.col("text").cast("binary"), F.lit(self.piece)
        parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size)), lambda i: bytes_.substr((i * size + 1).cast("int"), size))
        return self.long.select("doc_id", "n", "x", F.posexplode(parts).alias("at", "piece"))

    def _summed(self) -> DataFrame:
        """_id, _n, _x, fp: each huge text's pieces, hashed apart, shifted by what follows them, and summed."""
        piece, reduce = self.piece, self.reduce

        def shifted(batches):
            for batch in batches:
                column = batch.column("piece").cast(pa.large_binary())
                offsets = np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1, offset=8 * column.offset)
                h = piece_hashes(np.frombuffer(column.buffers()[2], np.uint8), offsets[:-1], offsets[1:])
                end = np.minimum(batch.column("at").to_numpy().astype(np.int64) * piece + piece, batch.column("n").to_numpy())
                after = batch.column("n").to_numpy() - end
                moved = [pa.array((h[:, k] * power(b, after, m) % np.uint64(m)).astype(np.int64)) for k, (b, m) in enumerate(zip(BASES, MODULI))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n", "x", "at")), *moved], names=["_id", "_n", "_x", "at", "h1", "h2"])

        def packed(batches):
            for batch in batches:
                fp = reduce((batch.column("h1").to_numpy() << 31) | batch.column("h2").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_n", "_x")), pa.array(fp)], names=["_id", "_n", "_x", "fp"])

        dealt = self._pieces().repartition(partitions(self.long.sparkSession), "doc_id", "x", "at")
        parts = dealt.mapInArrow(shifted, f"_id {self.kind}, _n long, _x long, at int, h1 long, h2 long").distinct()
        sums = parts.groupBy("_id", "_n", "_x").agg((F.sum("h1") % MODULI[0]).alias("h1"), (F.sum("h2") % MODULI[1]).alias("h2"))
        return sums.mapInArrow(packed, f"_id {self.kind}, _n long, _x long, fp long")

    def pieces(self, bits: np.ndarray) -> DataFrame:
        """fp, n, at, piece of the rows whose fingerprint's bit is set."""
        piece, reduce = self.piece, self.reduce
        shared = self.rows.sparkSession.sparkContext.broadcast(bits)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = lowered(batch.column("text"))
            fp = reduce(fingerprints(data, offsets, piece))
            asked = np.flatnonzero(is_set(shared.value, fp))
            text, nth, begin, end = cut_up(offsets, piece)
            own = np.flatnonzero(np.isin(text, asked))
            text, nth = text[own], nth[own]
            content = pa.array([data[a:b].tobytes() for a, b in zip(begin[own], end[own])], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(fp[text]), pa.array(np.diff(offsets)[text]), pa.array(nth.astype(np.int32)), content], names=["fp", "n", "at", "piece"])

        whole = map_arrow(self.rows, run, "fp long, n long, at int, piece binary")
        if not self.parts:
            return whole
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("x") == F.col("_x")) & (F.col("n") == F.col("_n"))
        return whole.unionByName(self._pieces().join(self._summed(), same).select("fp", "n", "at", "piece"))


def is_set(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    at = fp & (BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def shared_bits(facts: DataFrame) -> np.ndarray:
    """A bitmap over fingerprints modulo BITS: those of more than one row are set.  Its size is fixed."""
    place = (F.col("fp").bitwiseAND(BITS - 1) + 1).alias("place")
    several = facts.groupBy("fp", "n").count().where("count > 1").select(place)
    maps = several.groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("m"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in maps.collect():  # 4 KB each, BITS / 32768 of them at most
        a = (r["b"] - 1) * 4096
        bits[a : a + 4096] = np.frombuffer(bytes(r["m"]), np.uint8)[: BITS // 8 - a]
    return bits


def settle(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (doc_id, sha, keys) of equal keys are one group: the result's columns.

    Large groups, of which there can be 65,536 at most, are broadcast to their rows,
    which then stay where they are; the others meet theirs by a join.
    """
    large = max(LARGE, -(-rows.count() // (1 << 16)))
    single = rows.groupBy("doc_id", "sha", *keys).agg(F.count("*").alias("_m"))
    groups = single.groupBy(*keys).agg(F.max("doc_id").alias("keep_id"), F.sum("_m").alias("group_size"))
    hot, rest = F.broadcast(groups.where(F.col("group_size") >= large)), groups.where(F.col("group_size") < large)
    met = single.join(hot, keys).unionByName(single.join(hot, keys, "left_anti").join(rest, keys))
    each = met.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, piece: int = PIECE, huge: int = HUGE, reduce: Callable[[np.ndarray], np.ndarray] = lambda fp: fp) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lowering A-Z; a null counts as empty.
    Of a group the row of the largest doc_id stays, one row if several have that
    id (rows equal in id and text are told apart only by their number).  A null id
    is smaller than all others.  Further columns are ignored, an empty table gives
    no rows.  Texts of more than `huge` bytes are hashed and compared by pieces in
    different tasks.  Groups may be of any size, and results are exact whatever the
    fingerprints; `reduce` weakens them in tests.
    """
    marks = Marks(docs, piece, huge, reduce)
    facts = cut(marks.facts())
    # Each place of a group must have one content; partial aggregation leaves one copy a map task.
    contents = marks.pieces(shared_bits(facts)).distinct().groupBy("fp", "n", "at").count()
    unequal = cut(contents.where("count > 1").select("fp", "n").distinct())
    if unequal.isEmpty():
        return settle(facts, ["fp", "n"])
    plain = settle(facts.join(unequal, ["fp", "n"], "left_anti"), ["fp", "n"])
    text = _ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    known = facts.join(unequal, ["fp", "n"], "left_semi").select("doc_id", "sha").distinct().toDF("_id", "_sha")
    whole = docs.select("doc_id", text.alias("_text")).withColumn("sha", F.unhex(F.sha2("_text", 256)))
    asked = whole.join(known, F.col("sha").eqNullSafe(F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return plain.unionByName(settle(asked, ["_text"]))
