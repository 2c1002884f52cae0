"""Removal of passages that an earlier document already has: repeated-phrase automata.

A word goes if a window of `window` words that covers it also occurs in a
document with a smaller id.  Nothing is sampled; the work is cut down in steps
that can't lose a window:

1. Blocks.  Documents are dealt by a hash of id and text into blocks of bounded
   bytes.  Each window has a seed: the `seed`-word phrase in it with the least
   hash.  Equal windows have equal seeds, and neighbouring windows mostly share
   theirs, so a block has one seed for about five words.  Blocks send the
   distinct seeds with their number of documents to shards by hash; a seed of
   two documents or more recurs.  One block sends one row's worth for a seed,
   however many of its documents have it.
2. Confirmation.  Windows around a recurring seed go out as segments (at most
   2 * window - seed words), by their seed, to shards: each distinct text once a
   block, with the least and largest document that has it there.  A shard
   confirms, word by word, which windows are in two documents or more, and each
   one's smallest document.  Seeds in over `hot` documents go as single windows
   by the window's own hash, so that no shard gathers a phrase that a third of
   all documents share.
3. Location.  The confirmed passages (a segment's runs of recurring windows, with
   their first documents) go back to the blocks that sent them.  Each block
   compiles them into Aho-Corasick automata of bounded size and streams its whole
   documents through: what the automata report is where the passages are, in
   whichever documents, and nothing else says so.  Words of a window whose first
   document is a smaller one are cut out.

Automata read words, not bytes: each word is a fixed number of symbols, the n-th
of them from an alphabet of its own, so a passage matches at word boundaries only
and no state has more than 256 successors.

Documents are shuffled once (all three steps read that exchange).
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, mix, partitions, split_words, string_hashes

BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
#: Symbols of passages in one automaton (about 100 bytes each); a block with more compiles several.
AUTOMATON = 1 << 20
_LAST = np.iinfo(np.int64).max


@dataclass
class Block:
    """The words of some documents, side by side, sorted by document."""

    order: np.ndarray
    doc: np.ndarray  # id of each document; null ids as the largest number
    offsets: np.ndarray  # words of document i: offsets[i]:offsets[i + 1]
    word: np.ndarray  # hash of each word
    code: np.ndarray  # number of each word within the block
    text: memoryview  # all documents' words, joined by one space within a document
    begin: np.ndarray  # first byte of each word
    end: np.ndarray

    def phrase(self, first: int, past: int) -> bytes:
        return bytes(self.text[self.begin[first] : self.end[past - 1]])


def read_block(table: pa.Table) -> Block:
    pa.default_memory_pool().release_unused()  # what the worker's last block held
    order = pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
    table = table.take(order).combine_chunks()
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    doc = pc.fill_null(table.column("doc_id"), _LAST).to_numpy()
    flat, offsets = split_words(texts)
    codes, distinct = encode(flat)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), flat), pa.scalar(" ", flat.type)).cast(pa.large_binary())
    at = np.frombuffer(joined.buffers()[1], np.int64, count=len(joined) + 1) if len(joined) else np.zeros(1, np.int64)
    length = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    run = np.cumsum(length + 1) - (length + 1)
    counts = np.diff(offsets)
    some = counts > 0
    shift = np.zeros(len(counts), np.int64)
    shift[some] = at[:-1][some] - run[offsets[:-1][some]]
    begin = run + np.repeat(shift, counts)
    data = joined.buffers()[2] if len(joined) else None
    return Block(order.to_numpy(), doc, offsets, string_hashes(distinct)[codes], codes, memoryview(data) if data is not None else memoryview(b""), begin, begin + length)


@dataclass
class Segments:
    """Runs of windows with one seed: first window, number of windows, seed's hash, document."""

    first: np.ndarray
    count: np.ndarray
    seed: np.ndarray
    doc: np.ndarray


def _rolling(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    size = len(word) - n + 1
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + word[k : k + size]
    return mix(h)


def segments(block: Block, window: int, seed: int) -> Segments:
    phrases = _rolling(block.word, seed)
    counts = np.diff(block.offsets)
    in_doc = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    nth = np.arange(len(in_doc)) - np.repeat(np.cumsum(np.maximum(counts - window + 1, 0)) - np.maximum(counts - window + 1, 0), np.maximum(counts - window + 1, 0))
    first = block.offsets[in_doc] + nth
    if not len(first):
        none = np.zeros(0, np.int64)
        return Segments(none, none, np.zeros(0, np.uint64), none)
    least = np.lib.stride_tricks.sliding_window_view(phrases, window - seed + 1).argmin(axis=1)
    at = first + least[first]
    begins = np.ones(len(first), bool)
    begins[1:] = (at[1:] != at[:-1]) | (in_doc[1:] != in_doc[:-1])
    where = np.flatnonzero(begins)
    return Segments(first[where], np.diff(np.append(where, len(first))), phrases[at[where]], block.doc[in_doc[where]])


def _rows(shard: np.ndarray, block: int, columns: dict[str, np.ndarray]) -> dict[str, list]:
    """Columns (already in order of shard) cut into one binary value per shard."""
    cuts = np.flatnonzero(np.diff(shard, prepend=-1)) if len(shard) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(shard))
    out: dict[str, list] = {"shard": shard[cuts].tolist(), "block": [block] * len(cuts)}
    for name, values in columns.items():
        out[name] = [values[a:b].tobytes() for a, b in zip(cuts, ends)]
    return out


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binaries, and the row of each."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    sizes = [len(x) for x in parts]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.repeat(np.arange(len(parts)), sizes)


def _first(table: pa.Table, name: str) -> int:
    return table.column(name)[0].as_py()


def confirm(texts: list[bytes], low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recurring windows of the texts: index of the text, number of the window in it, smallest document.

    A text is in documents from low to high (equal: in one alone).  Windows are
    grouped by a hash of their words; a group's members are compared word by
    word with its first, so the groups are exact.
    """
    flat, offsets = split_words(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    codes, _ = encode(flat)
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    of = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[:-1][of] + nth
    if not len(at):
        return of, nth, at
    groups, first, group = np.unique(_rolling(mix(codes.astype(np.uint64) + np.uint64(1)), window)[at], return_index=True, return_inverse=True)
    alike = np.ones(len(at), bool)
    for k in range(window):
        alike &= codes[at + k] == codes[at[first][group] + k]
    if not alike.all():  # two window texts with one hash: number all windows by their words
        rows = np.lib.stride_tricks.sliding_window_view(codes, window)[at]
        groups, first, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
    least, most = np.full(len(groups), _LAST), np.full(len(groups), np.iinfo(np.int64).min)
    np.minimum.at(least, group, low[of])
    np.maximum.at(most, group, high[of])
    shared = (least < most)[group]
    return of[shared], nth[shared], least[group][shared]


class Stream:
    """A block's documents as one text of symbols, a mark after each document."""

    def __init__(self, block: Block):
        size, docs = len(block.code), len(block.doc)
        counts = np.diff(block.offsets)
        self.place = np.arange(size) + np.repeat(np.arange(docs), counts)  # of each word, counted in words and marks
        distinct = int(block.code.max(initial=0)) + 1
        line = np.full(size + docs, distinct)
        line[self.place] = block.code
        self.word = np.cumsum(np.bincount(self.place, minlength=size + docs)) - 1  # of each place that has one
        self.width = max(1, -(-distinct.bit_length() // 8))
        symbols = np.empty((len(line), self.width), "<u4")
        for k in range(self.width):
            symbols[:, k] = 0x100 + (k << 8) + (line >> (8 * k) & 0xFF)
        self.text = symbols.tobytes().decode("utf-32-le")

    def phrase(self, first: int, words: int) -> str:
        a = int(self.place[first]) * self.width
        return self.text[a : a + words * self.width]

    def matches(self, passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Every occurrence of every passage (all distinct): first word, and passage."""
        last, which = [], []
        begin = 0
        while begin < len(passages):
            automaton, room, end = ahocorasick.Automaton(), AUTOMATON, begin
            while end < len(passages) and (room > 0 or end == begin):
                automaton.add_word(passages[end], end)
                room -= len(passages[end])
                end += 1
            automaton.make_automaton()
            found = list(automaton.iter(self.text))
            last.append(np.fromiter((x for x, _ in found), np.int64, len(found)))
            which.append(np.fromiter((x for _, x in found), np.int64, len(found)))
            begin = end
        if not last:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.concatenate(which)
        words = np.array([len(x) // self.width for x in passages])
        return self.word[np.concatenate(last) // self.width - words[which] + 1], which


def locate(block: Block, piece: np.ndarray, first: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in a recurring window, and of these the words in one that a smaller document has.

    first: where a confirmed window begins in the block (one of its occurrences), by piece and
    ascending within it; owner: its smallest document.  A piece's runs of windows are the passages;
    they aren't joined across pieces, as another document may have one piece without the next.
    """
    size = len(block.code)
    stream = Stream(block)
    begins = np.ones(len(first), bool)
    begins[1:] = (np.diff(first) != 1) | (np.diff(piece) != 0)
    starts = np.flatnonzero(begins)
    known: dict[str, int] = {}
    chosen = []
    for a, n in zip(starts.tolist(), np.diff(np.append(starts, len(first))).tolist()):
        phrase = stream.phrase(first[a], n + window - 1)
        if phrase not in known:
            known[phrase] = len(known)
            chosen.append((a, n))
    at, which = stream.matches(list(known))
    run = np.array(chosen, np.int64).reshape(-1, 2)
    n = run[which, 1]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    window_at = np.repeat(at, n) + nth
    doc = np.repeat(block.doc, np.diff(block.offsets))
    earlier = owner[np.repeat(run[which, 0], n) + nth] < doc[window_at]

    def covered(starts: np.ndarray) -> np.ndarray:
        change = np.bincount(starts, minlength=size + 1) - np.bincount(starts + window, minlength=size + 1)
        return np.cumsum(change)[:size] > 0

    return covered(window_at), covered(window_at[earlier])


def remove_repeats(docs: DataFrame, window: int = 13, seed: int = 5, hot: int = 512) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_text, removed, n_recurring.

    kept_text is the kept words joined by one space; removed holds word spans
    (from 0, end exclusive); n_recurring counts the words of every located
    passage, the first document's included.  Null and empty texts have no words.
    Long texts are searched whole, in one block.  Repeated ids are one document's: they
    don't remove each other's words.  A null id counts as larger than any other.
    Rows equal in id and text are cut once and come out as often as they are there;
    others are spread over blocks, whatever their ids.  Columns other than doc_id and text are ignored.  An empty table gives
    no rows.
    """
    if not 0 < seed <= window or window - seed >= 64:
        raise ValueError("a window has 1 to 64 places for its seed")
    #: A bit for each window of a segment.
    bits = "<u2" if window - seed < 16 else "<u8"
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows equal in id and text are worked on once: a row may be there a million times.
    once = base.groupBy("doc_id", F.xxhash64("text")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    base = base.withColumn("copies", F.lit(1).cast("long")) if once else base.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    size = base.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    blocks = max(partitions(spark), -(-size // BLOCK_BYTES))
    shards = max(partitions(spark), -(-size // SHARD_BYTES))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    by_block = lambda: dealt.groupBy("block")

    binaries = lambda *names: [(x, pa.binary()) for x in names]
    pieces = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *binaries("number", "low", "high", "texts")])
    passages = pa.schema([("block", pa.int32()), *binaries("number", "mark", "owner")])

    def shard_of(h: np.ndarray) -> np.ndarray:
        return (mix(h) % np.uint64(shards)).astype(np.int64)

    def send_seeds(table: pa.Table) -> pa.Table:
        block = read_block(table)
        s = segments(block, window, seed)
        order = np.lexsort((s.doc, s.seed))
        h, doc = s.seed[order], s.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new_doc = new.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        distinct = h[new]
        count = np.add.reduceat(new_doc.astype(np.uint32), np.flatnonzero(new)).astype("<u4") if len(h) else np.zeros(0, "<u4")
        to = shard_of(distinct)
        order = np.argsort(to, kind="stable")
        rows = _rows(to[order], _first(table, "block"), {"seeds": distinct[order], "counts": count[order]})
        return pa.table(rows, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("seeds", pa.binary()), ("counts", pa.binary())]))

    def recurring(table: pa.Table) -> pa.Table:
        h, row = _joined(table.column("seeds"), "<u8")
        count, _ = _joined(table.column("counts"), "<u4")
        distinct, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, count, len(distinct))
        keep = total[at] > 1
        block = table.column("block").to_numpy()[row]
        order = np.flatnonzero(keep)[np.argsort(block[keep], kind="stable")]
        rows = _rows(block[order], 0, {"seeds": h[order], "hot": (total[at] > hot)[order].astype(np.uint8)})
        return pa.table({"block": rows["shard"], "seeds": rows["seeds"], "hot": rows["hot"]}, schema=pa.schema([("block", pa.int32()), ("seeds", pa.binary()), ("hot", pa.binary())]))

    def send_pieces(table: pa.Table, known: pa.Table) -> pa.Table:
        """Segments of recurring seeds and windows of hot ones, each text once.

        A segment's number is its own; a window's is that of its first word after those of all segments.
        """
        if not table.num_rows or not known.num_rows:
            return pieces.empty_table()
        block = read_block(table)
        s = segments(block, window, seed)
        seeds, _ = _joined(known.column("seeds"), "<u8")
        is_hot, _ = _joined(known.column("hot"), np.uint8)
        order = np.argsort(seeds)
        seeds, is_hot = seeds[order], is_hot[order]
        at = np.minimum(np.searchsorted(seeds, s.seed), len(seeds) - 1)
        found = seeds[at] == s.seed
        cool, warm = np.flatnonzero(found & (is_hot[at] == 0)), np.flatnonzero(found & (is_hot[at] == 1))
        count = s.count[warm]
        each = np.repeat(s.first[warm], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first = np.concatenate([s.first[cool], each])
        past = np.concatenate([s.first[cool] + s.count[cool], each + 1]) + window - 1
        doc = np.concatenate([s.doc[cool], np.repeat(s.doc[warm], count)])
        number = np.concatenate([cool, len(s.first) + each])
        to = shard_of(np.concatenate([s.seed[cool], _rolling(block.word, window)[each] if len(each) else np.zeros(0, np.uint64)]))
        distinct: dict[bytes, int] = {}
        text = np.array([distinct.setdefault(block.phrase(x, y), len(distinct)) for x, y in zip(first.tolist(), past.tolist())], np.int64)
        low, high = np.full(len(distinct), _LAST), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, text, doc)
        np.maximum.at(high, text, doc)
        _, one = np.unique(text, return_index=True)  # an occurrence of each text
        order = np.argsort(to[one], kind="stable")
        texts = np.array(list(distinct), object)[order] if len(distinct) else np.zeros(0, object)
        rows = _rows(to[one][order], _first(table, "block"), {"number": number[one][order].astype("<u4"), "low": low[order], "high": high[order]})
        ends = np.cumsum([len(x) // 8 for x in rows["low"]]).tolist()
        rows["texts"] = [b"\n".join(texts[a:b].tolist()) for a, b in zip([0, *ends], ends)]
        return pa.table(rows, schema=pieces)

    def confirmed(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        text = np.array([known.setdefault(t, len(known)) for x in table.column("texts").to_pylist() for t in x.split(b"\n")], np.int64)
        number, row = _joined(table.column("number"), "<u4")
        low, high = np.full(len(known), _LAST), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(low, text, _joined(table.column("low"), np.int64)[0])
        np.maximum.at(high, text, _joined(table.column("high"), np.int64)[0])
        of, nth, owner = confirm(list(known), low, high, window)
        mark = np.zeros(len(known), bits)
        np.bitwise_or.at(mark, of, np.left_shift(np.uint64(1), nth.astype(np.uint64)).astype(bits))
        begin = np.searchsorted(of, np.arange(len(known) + 1))
        block = table.column("block").to_numpy()[row]
        order = np.argsort(block, kind="stable")
        order = order[mark[text[order]] > 0]
        rows = _rows(block[order], 0, {"number": number[order], "mark": mark[text[order]]})
        ends = np.cumsum([len(x) // 4 for x in rows["number"]]).tolist()
        own = text[order].tolist()
        rows["owner"] = [b"".join(owner[begin[t] : begin[t + 1]].tobytes() for t in own[a:b]) for a, b in zip([0, *ends], ends)]
        return pa.table({"block": rows["shard"], **{x: rows[x] for x in ("number", "mark", "owner")}}, schema=passages)

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    result = pa.schema([("copies", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", span), ("n_recurring", pa.int64())])

    def cut_out(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result.empty_table()
        block = read_block(table)
        copies = table.column("copies").to_numpy()[block.order]
        recurs = gone = np.zeros(len(block.word), bool)
        if found.num_rows:
            s = segments(block, window, seed)
            number, _ = _joined(found.column("number"), "<u4")
            mark, _ = _joined(found.column("mark"), bits)
            owner, _ = _joined(found.column("owner"), np.int64)
            number = number.astype(np.int64)
            first = np.where(number < len(s.first), np.append(s.first, 0)[np.minimum(number, len(s.first))], number - len(s.first))
            piece, nth = np.nonzero(mark[:, None] >> np.arange(window - seed + 1, dtype=mark.dtype)[None, :] & mark.dtype.type(1))
            recurs, gone = locate(block, piece, first[piece] + nth, owner, window)
        out: dict[str, list] = {name: [] for name in result.names}
        for d in range(len(block.doc)):
            a, b = int(block.offsets[d]), int(block.offsets[d + 1])
            own = gone[a:b]
            out["copies"].append(int(copies[d]))
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            out["doc_id"].append(None if block.doc[d] == _LAST else int(block.doc[d]))
            out["n_words"].append(b - a)
            out["n_removed"].append(int(own.sum()))
            out["n_recurring"].append(int(recurs[a:b].sum()))
            out["removed"].append([{"start": x, "end": y} for x, y in edges.tolist()])
            kept = [0, *edges.ravel().tolist(), b - a]
            out["kept_text"].append(b" ".join(block.phrase(a + x, a + y) for x, y in zip(kept[::2], kept[1::2]) if y > x).decode())
        return pa.table(out, schema=result)

    seeds = by_block().applyInArrow(send_seeds, "shard int, block int, seeds binary, counts binary")
    known = seeds.groupBy("shard").applyInArrow(recurring, "block int, seeds binary, hot binary")
    sent = by_block().cogroup(known.groupBy("block")).applyInArrow(send_pieces, "shard int, block int, number binary, low binary, high binary, texts binary")
    back = sent.groupBy("shard").applyInArrow(confirmed, "block int, number binary, mark binary, owner binary")
    found = by_block().cogroup(back.groupBy("block")).applyInArrow(cut_out, "copies long, doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start: long, end: long>>, n_recurring long")
    each = found if once else found.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.drop("copies", "_nth")
