"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

Counts cover every training text.  Words are keyed by a 64-bit hash.  Classes
come in two steps.  Exchange clustering moves items between classes while the
class bigrams' mutual information rises; the items are the `own` commonest
words, `endings` groups of the others by their last three bytes, and the end of
a text, so its matrix is bounded whatever the corpus.  Then every other word of
the training texts takes one exchange step by itself, by the word's own counts
of neighbour classes (summed up over the cluster) against that class matrix.
Only words that no training text has keep the class of their ending.

    log10 P(text) = sum over tokens of log10 P(class | class before) + log10 P(word | class)

Transitions are counted again with the words' final classes.  Emissions use
every word's own count, known or not.  Counts and classes of words beyond the
`table` commonest (a bounded table that tasks hold) come by a join on the word.  A word's
neighbour counts travel packed, one row a word and map task, and are summed up
while they stream by in the order of words.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, encode, fold, mix, partitions, slices, split_words, string_hashes

ADD = 0.1


@dataclass
class ClassModel:
    """What tasks need: bounded tables, never the vocabulary."""

    hashes: np.ndarray  # of the commonest words, ascending
    counts: np.ndarray
    word_classes: np.ndarray  # class of each of them
    by_ending: np.ndarray  # class of each ending, for words of no training text
    transition: np.ndarray  # log10
    divisor: np.ndarray  # log10 of each class's emission divisor
    share: np.ndarray  # what transitions are smoothed towards
    tokens: int  # N
    distinct: int  # V
    texts: int


def _ending(words: pa.Array, endings: int) -> np.ndarray:
    """Item offset by the last three bytes."""
    raw = words.cast(pa.large_binary())
    if not len(raw):
        return np.zeros(0, np.int64)
    return (string_hashes(pc.binary_slice(raw, -3, None)) % np.uint64(endings)).astype(np.int64)


def count_words(texts: DataFrame, endings: int) -> DataFrame:
    """(h, ending, c) of all texts; summed up before the shuffle."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            h, e, c = (np.concatenate(x) for x in zip(*held))
            distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
            return distinct, e[first], np.bincount(at, c, len(distinct)).astype(np.int64)

        def batch_of(h, e, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(c)], names=["h", "ending", "c"])

        for batch in batches:
            for part in slices(batch):
                flat, _ = split_words(part.column("text"), lower=True)
                codes, distinct = encode(flat)
                held.append((string_hashes(distinct), _ending(distinct, endings), np.bincount(codes, minlength=len(distinct))))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield batch_of(*held.pop())
        if held:
            yield batch_of(*merged())

    rows = texts.select("text").mapInArrow(run, "h long, ending int, c long")
    return rows.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def _places(h: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each word in the table of the commonest (-1: not there)."""
    if not len(hashes):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, at, -1)


def _items(distinct: pa.Array, h: np.ndarray, hashes: np.ndarray, items: np.ndarray, endings: int, own: int) -> np.ndarray:
    """Item of each word."""
    at = _places(h, hashes)
    item = np.where(at >= 0, items[at] if len(items) else -1, -1)
    return np.where(item >= 0, item, own + _ending(distinct, endings))


def bigrams(texts: DataFrame, hashes: np.ndarray, items: np.ndarray, endings: int, own: int) -> np.ndarray:
    """Matrix of item bigrams over all texts; a text's first word follows the end item."""
    n = own + endings + 1
    shared = texts.sparkSession.sparkContext.broadcast((hashes, items))

    def run(batches):
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for part in slices(batch):
                flat, offsets = split_words(part.column("text"), lower=True)
                codes, distinct = encode(flat)
                item = _items(distinct, string_hashes(distinct), *shared.value, endings, own)
                line = with_ends(item[codes], offsets, n - 1)
                total += np.bincount(line[:-1] * n + line[1:], minlength=n * n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    rows = texts.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n, np.int64)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(n, n)


def with_ends(items: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    """The end item, and every text's items followed by it."""
    counts = np.diff(offsets)
    out = np.full(len(items) + len(counts) + 1, end)
    out[1 + np.arange(len(items)) + np.repeat(np.arange(len(counts)), counts)] = items
    return out


def exchange(matrix: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of each item by exchange clustering; the last item has class `classes` for itself.

    An item moves to the class where sum f(N(c, d)) - sum f(N(c, .)) - sum f(N(., d)),
    f(x) = x log x, is largest, ties to the class it is in, then to the lowest.
    """
    n = len(matrix)
    f = lambda x: x * np.log(np.maximum(x, 1))
    m = matrix.astype(float)
    frequency = m[:-1].sum(axis=1)
    of = np.empty(n, np.int64)
    of[np.argsort(-frequency, kind="stable")] = np.arange(n - 1) % classes
    of[-1] = classes
    k = classes + 1
    one = np.eye(k)[of]
    joint = one.T @ m @ one
    # An item's bigrams by class, kept up to date as items move.
    after, before = m @ one, m.T @ one
    for _ in range(sweeps):
        moves = 0
        for w in np.argsort(-frequency, kind="stable"):
            if not frequency[w]:
                continue
            old = of[w]
            r, q, s = after[w].copy(), before[w].copy(), m[w, w]
            r[old] -= s
            q[old] -= s
            rest = joint.copy()
            rest[old] -= r
            rest[:, old] -= q
            rest[old, old] -= s
            at_rest = f(rest)
            total_out, total_in = rest.sum(axis=1), rest.sum(axis=0)
            # Gain of adding w to class c: its row, its column, and the corner, which both touch.
            gain = (f(rest + r[None, :]) - at_rest).sum(axis=1) + (f(rest + q[:, None]) - at_rest).sum(axis=0)
            d = np.diagonal(rest)
            gain += f(d + r + q + s) - f(d + r) - f(d + q) + f(d)
            gain -= f(total_out + r.sum() + s) - f(total_out) + f(total_in + q.sum() + s) - f(total_in)
            gain = gain[:-1]
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                continue
            moves += 1
            of[w] = new
            joint = rest
            joint[new] += r
            joint[:, new] += q
            joint[new, new] += s
            after[:, old] -= m[:, w]
            after[:, new] += m[:, w]
            before[:, old] -= m[w]
            before[:, new] += m[w]
        if not moves:
            break
    return of


_N = 22  # bits of a packed count; the slot is above them
_HELD = 1 << (_N - 1)


def pack_words(h: np.ndarray, ending: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """(h, cells): per word its ending and its (slot, n), as 32-bit numbers.  word: ascending, none without entries."""
    sizes = np.bincount(word, minlength=len(h)) + 1
    begins = np.cumsum(sizes) - sizes
    flat = np.empty(len(h) + len(word), "<u4")
    flat[begins] = ending
    flat[np.arange(len(word)) + word + 1] = (slot << _N) + n
    offsets = np.append(begins, len(flat)).astype(np.int32) * 4
    cells = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), cells], names=["h", "cells"])


def unpack_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h and ending per row, and row, slot and n per entry."""
    cells = batch.column("cells")
    sizes = pc.binary_length(cells).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    flat = np.frombuffer(b"".join(cells.to_pylist()), "<u4").astype(np.int64)
    head = np.cumsum(sizes) - sizes
    entry = np.ones(len(flat), bool)
    entry[head] = False
    return batch.column("h").to_numpy(), flat[head], np.repeat(np.arange(len(sizes)), sizes - 1), flat[entry] >> _N, flat[entry] & ((1 << _N) - 1)


def contexts(texts: DataFrame, hashes: np.ndarray, items: np.ndarray, endings: int, own: int, of: np.ndarray) -> DataFrame:
    """Packed counts (h, cells) of the words that are no items of their own, sorted by word; a word may have several rows.

    With k classes, slot d is a neighbour of class d after the word, k + d one
    before it, and 2k the word itself after it.
    """
    k = int(of[-1]) + 1
    if 2 * k >= 1 << (32 - _N):
        raise ValueError("too many classes")
    shared = texts.sparkSession.sparkContext.broadcast((hashes, items, of))

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        tokens = 0

        def merged():
            h, ending, slot, n = (np.concatenate(x) for x in zip(*held))
            distinct, first, at = np.unique(h, return_index=True, return_inverse=True)
            cell, at = np.unique(at * (2 * k + 1) + slot, return_inverse=True)
            return distinct, ending[first], cell // (2 * k + 1), cell % (2 * k + 1), np.bincount(at, n, len(cell)).astype(np.int64)

        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                flat, offsets = split_words(part.column("text"), lower=True)
                codes, distinct = encode(flat)
                h = string_hashes(distinct)
                table, item_of, classes = shared.value
                item = np.append(_items(distinct, h, table, item_of, endings, own), own + endings)
                class_of, free = classes[item], (item >= own) & (item < own + endings)
                line = with_ends(codes, offsets, len(distinct))
                for c in range(0, len(line) - 1, _HELD // 2):  # no count can outgrow its bits
                    a, b = line[c : c + _HELD // 2], line[c + 1 : c + 1 + _HELD // 2]
                    a = a[: len(b)]
                    same = a == b
                    after, before, twice = free[a] & ~same, free[b] & ~same, free[a] & same
                    word = np.concatenate([a[after], b[before], a[twice]])
                    slot = np.concatenate([class_of[b[after]], k + class_of[a[before]], np.full(twice.sum(), 2 * k)])
                    cell, n = np.unique(word * (2 * k + 1) + slot, return_counts=True)
                    word = cell // (2 * k + 1)
                    held.append((h[word], item[word] - own, cell % (2 * k + 1), n))
                    tokens += len(a)
                    if sum(len(x[0]) for x in held) > 600_000 or tokens > _HELD:
                        distinct_, ending, owner, slot, n = merged()
                        held = [(distinct_[owner], ending[owner], slot, n)]
                        if len(owner) > 300_000 or tokens > _HELD:
                            yield pack_words(distinct_, ending, owner, slot, n)
                            held, tokens = [], 0
        if held:
            yield pack_words(*merged())

    rows = texts.select("text").mapInArrow(run, "h long, cells binary")
    return rows.repartition(partitions(texts.sparkSession), "h").sortWithinPartitions("h")


def exchange_step(joint: np.ndarray, old: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray) -> np.ndarray:
    """New class of each word (old: the present ones), each moved alone against the class matrix.

    Entries (word, slot, n) as `contexts` has them, ascending by word.
    """
    k = len(joint)
    f = lambda x: x * np.log(np.maximum(x, 1))
    r, q, s = np.zeros((len(old), k)), np.zeros((len(old), k)), np.zeros(len(old))
    n = n.astype(float)
    out, into, twice = slot < k, (slot >= k) & (slot < 2 * k), slot == 2 * k
    r[word[out], slot[out]] = n[out]
    q[word[into], slot[into] - k] = n[into]
    s[word[twice]] = n[twice]
    here = np.arange(k) == old[:, None]
    gain = np.zeros((len(old), k))
    # The class matrix without the word, then with it: only where the word has counts do the two differ.
    for chosen, matrix, shift, own, other in ((out, joint.T, 0, r, q), (into, joint, k, q, r)):
        w, d = word[chosen], slot[chosen] - shift
        if not len(w):
            continue
        at_home = (d == old[w])[:, None]
        rest = matrix[d] - here[w] * n[chosen][:, None] - at_home * (other[w] + here[w] * s[w][:, None])
        first = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[first]] += np.add.reduceat(f(rest + n[chosen][:, None]) - f(rest), first, axis=0)
    d = np.diagonal(joint) - here * (r + q + s[:, None])
    gain += f(d + r + q + s[:, None]) - f(d + r) - f(d + q) + f(d)
    for total, own in ((joint.sum(axis=1), r), (joint.sum(axis=0), q)):
        moved = (own.sum(axis=1) + s)[:, None]
        rest = total - here * moved
        gain -= f(rest + moved) - f(rest)
    gain = gain[:, :-1]
    new = gain.argmax(axis=1)
    row = np.arange(len(old))
    return np.where(gain[row, new] > gain[row, old] + 1e-9, new, old)


def assign(found: DataFrame, joint: np.ndarray, by_ending: np.ndarray, entries: int = 16_384) -> DataFrame:
    """(h, c, class) of the words of `contexts`, whose rows are summed up as they come; about `entries` counts at a time."""
    k = len(joint)

    def run(batches):
        # The last word's sums, as further rows of it may follow.
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def moved(h, ending, word, slot, n):
            # Each occurrence has one neighbour after it.
            c = np.bincount(word, n * ((slot < k) | (slot == 2 * k)), len(h)).astype(np.int64)
            sizes = np.cumsum(np.bincount(word, minlength=len(h)))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // entries)) + 1).tolist(), len(h)]
            for a, b in zip(cuts, cuts[1:]):
                own = (word >= a) & (word < b)
                new = exchange_step(joint, by_ending[ending[a:b]], word[own] - a, slot[own], n[own])
                yield pa.RecordBatch.from_arrays([pa.array(h[a:b]), pa.array(c[a:b]), pa.array(new.astype(np.int32))], names=["h", "c", "class"])

        for batch in batches:
            h, ending, row, slot, n = unpack_words(batch)
            h, ending = np.concatenate([kept[0], h]), np.concatenate([kept[1], ending])
            row, slot, n = np.concatenate([kept[2], row + len(kept[0])]), np.concatenate([kept[3], slot]), np.concatenate([kept[4], n])
            if not len(h):
                continue
            first = np.flatnonzero(np.diff(h, prepend=h[0] - 1) != 0)
            word_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
            cell, at = np.unique(word_of[row] * (2 * k + 1) + slot, return_inverse=True)
            n = np.bincount(at, n, len(cell)).astype(np.int64)
            word, slot, last = cell // (2 * k + 1), cell % (2 * k + 1), len(first) - 1
            done = word < last
            if last:
                yield from moved(h[first[:-1]], ending[first[:-1]], word[done], slot[done], n[done])
            kept = (h[first[-1:]], ending[first[-1:]], word[~done] - last, slot[~done], n[~done])
        if len(kept[0]):
            yield from moved(*kept)

    return found.mapInArrow(run, "h long, c long, class int")


def learn(texts: DataFrame, classes: int = 64, own: int = 1024, endings: int = 256, table: int = 1 << 18, sweeps: int = 8) -> tuple[ClassModel, DataFrame]:
    """The model without its transitions, and the table (h, c, class) of all words."""
    counts = cut(count_words(texts, endings))
    number = texts.count()
    # By steps of a sixteenth of an octave: at most a thousand rows for any corpus.
    step = F.floor(F.log2("c") * 16).cast("int")
    by_step = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("c").alias("c")).orderBy(F.col("step").desc()).collect()
    total = sum(r["c"] for r in by_step)
    distinct = sum(r["words"] for r in by_step)
    room, least = table, None
    for r in by_step:
        room -= r["words"]
        if room < 0:
            break
        least = r["step"]

    def commonest(words: DataFrame, *columns: str) -> list[np.ndarray]:
        """Of at most `table` words, by hash."""
        found = words.where(step >= least).select("h", *columns).toArrow() if least is not None else None
        if found is None:
            return [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in columns)]
        h = found.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        return [h[order], *(found.column(x).to_numpy()[order].astype(np.int64) for x in columns)]

    h, c = commonest(counts, "c")
    items = np.full(len(h), -1)
    first = np.lexsort((h, -c))[:own]
    items[first] = np.arange(len(first))
    matrix = bigrams(texts, h, items, endings, own)
    of = exchange(matrix, classes, sweeps)
    k = classes + 1
    one = np.eye(k)[of]
    by_ending = of[own : own + endings]
    found = assign(contexts(texts, h[first][np.argsort(h[first])], items[first][np.argsort(h[first])], endings, own, of), one.T @ matrix @ one, by_ending)
    settled = [(int(a), int(b), int(of[i])) for i, (a, b) in enumerate(zip(h[first].view(np.int64), c[first]))]
    words = cut(found.unionByName(texts.sparkSession.createDataFrame(settled, found.schema)))
    h, c, word_classes = commonest(words, "c", "class")
    in_class, class_words = np.zeros(k), np.zeros(k)
    for r in words.groupBy("class").agg(F.count("*").alias("words"), F.sum("c").alias("c")).collect():
        class_words[r["class"]], in_class[r["class"]] = r["words"], r["c"]
    share = (in_class + ADD) / (in_class + ADD).sum()
    share[-1] = (number + ADD) / (total + number + ADD * k)
    share[:-1] *= (1 - share[-1]) / max(share[:-1].sum(), 1e-300)
    divisor = np.log10(in_class + ADD * (class_words + 1))
    return ClassModel(h, c, word_classes, by_ending, np.zeros((k, k)), divisor, share, total + number, distinct + (number > 0), number), words


def class_lines(docs: DataFrame, model: ClassModel, words: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) -> doc_id, held_out, n_tokens, known, emitted, and the text's class bigrams.

    `pairs` are class before * k + class, `times` how often.  One row per row of docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.share)
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    fields = ["doc_id", "held_out", "n_tokens", "known", "common", "pairs", "times", "before", "after"]

    def lists(owner, values, n, kind=pa.int32()):
        """A list for each of n rows; owner ascending."""
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def run(batches):
        m = shared.value
        log_c = np.append(np.log10(m.counts + ADD), 0.0)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                n = part.num_rows
                flat, offsets = split_words(part.column("text"), lower=True)
                codes, distinct = encode(flat)
                h = string_hashes(distinct)
                at = _places(h, m.hashes)
                doc = np.repeat(np.arange(n), np.diff(offsets))
                place = at[codes]
                known = np.bincount(doc, place >= 0, n).astype(np.int64)
                common = np.bincount(doc, log_c[place], n)
                rare = place < 0
                cell, inverse, times = np.unique(doc[rare] * max(1, len(distinct)) + codes[rare], return_inverse=True, return_counts=True)
                who, word = cell // max(1, len(distinct)), cell % max(1, len(distinct))
                # Words of the table have their class, the others k and more: their number within the text.
                number = np.arange(len(cell)) - np.searchsorted(who, who)
                value = np.append(m.word_classes, -1)[place]
                value[rare] = k + number[inverse]
                line = with_ends(value, offsets, k - 1)
                owner = np.repeat(np.arange(n), np.diff(offsets) + 1)
                a, b = line[:-1], line[1:]
                settled = (a < k) & (b < k)
                pair, often = np.unique(owner[settled] * (k * k) + a[settled] * k + b[settled], return_counts=True)
                row = part.column("row").to_numpy()
                facts = pa.StructArray.from_arrays(
                    [
                        part.column("doc_id"), part.column("held_out"), pa.array(np.diff(offsets) + 1), pa.array(known), pa.array(common),
                        lists(pair // (k * k), pair % (k * k), n), lists(pair // (k * k), often, n), lists(owner[~settled], a[~settled], n), lists(owner[~settled], b[~settled], n),
                    ],
                    names=fields,
                )
                nothing = pa.nulls(len(cell), facts.type)
                # A text's own row carries its facts; its key is a number that no word's count matters to (n = 0).
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([row, row[who]])),
                        pa.array(np.concatenate([mix(row.astype(np.uint64)), h[word]]).view(np.int64)),
                        pa.array(np.concatenate([np.zeros(n, np.int32), times.astype(np.int32)])),
                        # The word's number within the text, and the class of its ending above it.
                        pa.array(np.concatenate([np.full(n, -1), number + (m.by_ending[_ending(distinct, len(m.by_ending))[word]] << 32)])),
                        pa.concat_arrays([facts, nothing]),
                    ],
                    names=["row", "h", "n", "number", "facts"],
                )

    ints = "array<int>"
    facts = f"struct<doc_id: {kind}, held_out: boolean, n_tokens: bigint, known: bigint, common: double, pairs: {ints}, times: {ints}, before: {ints}, after: {ints}>"
    rows = numbered.mapInArrow(run, f"row long, h long, n int, number long, facts {facts}")
    joined = rows.join(words.select(F.col("h").alias("word"), "c", "class"), F.col("h") == F.col("word"), "left")
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z))
    grouped = joined.groupBy("row").agg(
        F.first("facts", ignorenulls=True).alias("facts"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10(zero("c", 0) + F.lit(ADD))).alias("emitted"),
        F.array_sort(F.collect_list(F.when(F.col("number") >= 0, F.struct(F.col("number").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("number"), F.coalesce("class", F.shiftright("number", 32).cast("int")).alias("class"))))).alias("rare"),
    )
    flat = grouped.select("facts.doc_id", "facts.held_out", "facts.n_tokens", (F.col("facts.known") + F.col("known")).alias("known"), (F.col("facts.common") + F.col("emitted")).alias("emitted"),
                          "facts.pairs", "facts.times", "facts.before", "facts.after", F.col("rare.class").alias("rare"))

    def fill(batches):
        for batch in batches:
            n = batch.num_rows
            flat_of = lambda x: batch.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = lambda x: batch.column(x).value_lengths().to_numpy(zero_copy_only=False)
            classes, start = flat_of("rare"), np.concatenate([[0], np.cumsum(size("rare"))])
            owner = np.repeat(np.arange(n), size("before"))

            def settled(x):
                out = flat_of(x)
                open_ = out >= k
                out[open_] = classes[start[owner[open_]] + out[open_] - k]
                return out

            key = np.concatenate([np.repeat(np.arange(n), size("pairs")) * (k * k) + flat_of("pairs"), owner * (k * k) + settled("before") * k + settled("after")])
            cell, at = np.unique(key, return_inverse=True)
            often = np.bincount(at, np.concatenate([flat_of("times"), np.ones(len(owner), np.int64)]), len(cell)).astype(np.int64)
            columns = [batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "known", "emitted")]
            yield pa.RecordBatch.from_arrays([*columns, lists(cell // (k * k), cell % (k * k), n), lists(cell // (k * k), often, n)], names=["doc_id", "held_out", "n_tokens", "known", "emitted", "pairs", "times"])

    return flat.mapInArrow(fill, f"doc_id {kind}, held_out boolean, n_tokens long, known long, emitted double, pairs {ints}, times {ints}")


def with_transitions(model: ClassModel, lines: DataFrame, prior: float = 5.0) -> ClassModel:
    """The model with transitions from the class bigrams of the training rows."""
    k = len(model.share)

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            pair, n = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("pairs", "times"))
            total += np.bincount(pair, n, k * k).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    rows = lines.where("NOT held_out").select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    joint = np.zeros(k * k)
    joint[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    joint = joint.reshape(k, k)
    return replace(model, transition=np.log10((joint + prior * model.share[None, :]) / (joint.sum(axis=1, keepdims=True) + prior)))


def fit(texts: DataFrame, prior: float = 5.0, **sizes) -> tuple[ClassModel, DataFrame]:
    """The model, and the table (h, c, class) of all words' counts and classes."""
    model, words = learn(texts, **sizes)
    marked = texts.select("doc_id", F.lit(False).alias("held_out"), "text")
    return with_transitions(model, class_lines(marked, model, words), prior), words


def score_lines(lines: DataFrame, model: ClassModel) -> DataFrame:
    """The contract's columns, one row per row of lines."""
    k = len(model.share)
    # The end has no emission.
    step = (model.transition - np.where(np.arange(k) == k - 1, 0.0, model.divisor)[None, :]).ravel()
    scale = float(np.log10(model.tokens + ADD * (model.distinct + 1)))
    end = float(np.log10(model.texts + ADD))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            pair, times = (batch.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("pairs", "times"))
            owner = np.repeat(np.arange(n), batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False))
            path = np.bincount(owner, step[pair] * times, n)
            tokens, known, emitted = (batch.column(x).to_numpy() for x in ("n_tokens", "known", "emitted"))
            columns = [pa.array(x) for x in (tokens, known + int(model.texts > 0), np.full(n, int(model.tokens)), emitted + end - tokens * scale, emitted + path)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], names=names)

    kind = lines.schema["doc_id"].dataType.simpleString()
    return lines.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(docs: DataFrame, folds: int = 10, prior: float = 5.0, **sizes) -> DataFrame:
    """Fit on the rows outside fold 0 and score all rows.

    Null texts are empty: one token, the end.  Rows with a null id belong to the
    fold of the empty text.  Repeated rows are learnt from and scored each.
    Without training rows every count is 0.  Further columns are ignored.  Long
    texts are scored whole, a few megabytes of words at a time; an empty table gives
    no rows.  Words of equal counts are ordered by their hashes, so that equal
    corpora give equal models.
    """
    marked = docs.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "text")
    model, words = learn(marked.where("NOT held_out"), **sizes)
    lines = cut(class_lines(marked, model, words))
    return score_lines(lines, with_transitions(model, lines, prior))
