"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence gets a logistic score from
the words in it, and the document's score is their noisy-or with a small leak:
1 - (1 - leak) * product(1 - p_sentence).  Only document labels are known, so
the loss is the document's cross-entropy and its gradient reaches each sentence
through the noisy-or; the sentence scores then say where the offence is.

Training takes a bounded, documented sample (`sample_docs` labelled rows of
each class, of at most `sample_chars` characters each); scoring takes whole
texts of all rows.  Null and empty texts have no sentence, so they get the leak.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encode, fold, map_arrow, masked, sampled, split_words, string_hashes

_BREAK = "\x1e"
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


@dataclass
class MilModel:
    """Weights by feature, the sentence bias and the leak of the noisy-or."""

    features: list[str]
    weights: np.ndarray
    bias: float
    leak: float


def sentences(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Word codes, distinct normalised words, sentence of each word, document of each sentence.

    A sentence ends with a word that closes in . ! or ? (signs may follow) and
    at each line break.  Words are lower-cased and stripped of signs.
    """
    marked = pc.replace_substring(pc.fill_null(texts, ""), "\n", f" {_BREAK} ")
    flat, offsets = split_words(marked, lower=True)
    codes, raw = encode(flat)
    if len(raw) == 0:
        return codes, raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = pc.match_substring_regex(raw, r"[.!?][^\p{L}\p{N}]*$").to_numpy(zero_copy_only=False)
    is_break = pc.equal(raw, _BREAK).to_numpy(zero_copy_only=False)
    clean = pc.replace_substring_regex(raw, _EDGE, "")
    ends = (stop | is_break)[codes]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # A new sentence after each end, and at each document's first word.
    begins = np.zeros(len(codes), bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    begins[1:] |= ends[:-1]
    sentence = np.cumsum(begins) - 1
    sentence_doc = doc[begins]
    again, distinct = encode(clean)
    keep = ~is_break[codes]
    return again[codes][keep], distinct, sentence[keep], sentence_doc


def _features(distinct: pa.Array) -> list[pa.Array]:
    """Features of each distinct word: itself, and its first four and five characters.

    Inflected forms of a stem share the beginnings.  Shorter words have none.
    """
    distinct = distinct.cast(pa.large_string())
    out = [distinct]
    length = pc.utf8_length(distinct)
    for n in (4, 5):
        start = pc.binary_join_element_wise(pa.scalar(f"{n}:", pa.large_string()), pc.utf8_slice_codeunits(distinct, 0, n), pa.scalar("", pa.large_string()))
        out.append(pc.if_else(pc.greater_equal(length, n), start, pa.scalar("", pa.large_string())))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _evidence(n: np.ndarray, k: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of k positive documents among n, 0 if no more than the share lets expect."""
    part = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1) / np.maximum(b, 1e-300)), 0.0)
    g = 2 * (part(k, n * share) + part(n - k, n * (1 - share)))
    return np.where(k > n * share, g, 0.0)


def _cells(texts: list[str | None], labels: np.ndarray, vocabulary: int, least_docs: int, evidence: float, chunk: int = 128) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names of the chosen features, (sentence, feature) pairs, and each sentence's document.

    Two passes over the texts in chunks, so that what is held is the distinct
    features of the documents first and then the chosen pairs.
    """

    def parts(i: int):
        codes, distinct, sentence, sentence_doc = sentences(pa.array(texts[i : i + chunk], pa.string()))
        lists = _features(distinct) if len(distinct) else []
        return codes, sentence, sentence_doc, lists, [string_hashes(x) for x in lists]

    found, times, hits = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(texts), chunk):
        codes, sentence, sentence_doc, lists, hashed = parts(i)
        if not lists:
            continue
        occurs = np.unique(sentence_doc[sentence] * len(lists[0]) + codes)
        doc, word = occurs // len(lists[0]), occurs % len(lists[0])
        ids, at = np.unique(np.concatenate([h[word] for h in hashed]), return_inverse=True)
        pairs = np.unique(np.tile(doc, len(hashed)) * len(ids) + at)
        in_docs, positive = pairs % len(ids), labels[i + pairs // len(ids)] > 0
        both, where = np.unique(np.concatenate([found, ids]), return_inverse=True)
        merged = lambda old, own: np.bincount(where, np.concatenate([old, np.bincount(own, minlength=len(ids))]), len(both)).astype(np.int64)
        times, hits, found = merged(times, in_docs), merged(hits, in_docs[positive]), both
    empty = string_hashes(pa.array([""], pa.large_string()))[0]
    times[found == empty] = 0
    strength = _evidence(times, hits, float((labels > 0).mean()))
    chosen = np.flatnonzero((times >= least_docs) & (strength >= evidence))
    chosen = np.sort(found[chosen[np.argsort(-strength[chosen], kind="stable")][:vocabulary]])
    names: list[str] = [""] * len(chosen)
    rows, columns, docs, sentences_so_far = [], [], [], 0
    for i in range(0, len(texts), chunk):
        codes, sentence, sentence_doc, lists, hashed = parts(i)
        docs.append(sentence_doc + i)
        for values, h in zip(lists, hashed):
            at = np.minimum(np.searchsorted(chosen, h), max(0, len(chosen) - 1))
            known = chosen[at] == h if len(chosen) else np.zeros(len(h), bool)
            for k in np.flatnonzero(known).tolist():
                if not names[at[k]]:
                    names[at[k]] = values[k].as_py()
            hit = known[codes]
            # A feature counts once in a sentence.
            cell = np.unique(sentence[hit] * max(1, len(chosen)) + at[codes[hit]])
            rows.append((cell // max(1, len(chosen)) + sentences_so_far).astype(np.int32))
            columns.append((cell % max(1, len(chosen))).astype(np.int32))
        sentences_so_far += len(sentence_doc)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
    return names, join(rows), join(columns), join(docs).astype(np.int64)


def fit(texts: list[str | None], labels: np.ndarray, weights: np.ndarray | None = None, vocabulary: int = 1 << 16, rounds: int = 100, rate: float = 0.15, l2: float = 2e-3, least_docs: int = 3, evidence: float = 15.0) -> MilModel:
    """Full-batch Adam on the noisy-or likelihood.

    `weights` are per-document weights (for a sample that isn't drawn evenly
    over the classes).  The vocabulary holds the features of at least
    `least_docs` documents whose documents are positive more often than chance
    lets expect (log-likelihood ratio of `evidence` or more), the surest first.  Without documents of both classes the
    model has the leak alone, at the prior.
    """
    labels = np.asarray(labels, float)
    weights = np.ones(len(labels)) if weights is None else np.asarray(weights, float)
    prior = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.0
    if not len(labels) or labels.min() == labels.max():
        return MilModel([], np.zeros(0), -12.0, prior)
    names, row, column, sentence_doc = _cells(texts, labels, vocabulary, least_docs, evidence)
    if not names:
        return MilModel([], np.zeros(0), -12.0, prior)
    n = len(sentence_doc)
    w, b, leak = np.zeros(len(names)), -5.0, -4.0
    moment = [np.zeros(len(names) + 2), np.zeros(len(names) + 2)]
    total = weights.sum()
    for step in range(1, rounds + 1):
        z = b + np.bincount(row, w[column], n)
        p = _sigmoid(z)
        e = _sigmoid(np.array([leak]))[0]
        none = np.bincount(sentence_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels)) + np.log1p(-e)
        miss = np.exp(none)
        hit = np.maximum(1 - miss, 1e-9)
        # d loss / d none, where none = log of the chance that no sentence offends
        outer = weights * (labels * miss / hit - (1 - labels)) / total
        dz = outer[sentence_doc] * -p
        grad = np.concatenate([np.bincount(column, dz[row], len(w)) + l2 * w / len(labels) ** 0.5, [dz.sum()], [(outer * -e).sum()]])
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.99 * moment[1] + 0.01 * grad**2
        move = rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-7)
        w, b, leak = w - move[:-2], b - move[-2], leak - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - 2e-3, 0)
    used = np.flatnonzero(np.abs(w) > 0.02)
    return MilModel([names[k] for k in used.tolist()], w[used], float(b), float(_sigmoid(np.array([leak]))[0]))


def sentence_scores(texts: pa.Array, model: MilModel) -> tuple[np.ndarray, np.ndarray]:
    """Per sentence its probability, and its document."""
    codes, distinct, sentence, sentence_doc = sentences(texts)
    if not len(sentence_doc):
        return np.zeros(0), sentence_doc
    table, values = pa.array(model.features, pa.large_string()), np.append(model.weights, 0.0)
    weight = sum(values[pc.fill_null(pc.index_in(f, value_set=table), -1).to_numpy(zero_copy_only=False).astype(np.int64)] for f in _features(distinct))
    hit = weight[codes] != 0
    cell = np.unique(sentence[hit] * len(distinct) + codes[hit])
    z = model.bias + np.bincount(cell // len(distinct), weight[cell % len(distinct)], len(sentence_doc))
    return _sigmoid(z), sentence_doc


def score_toxicity(docs: DataFrame, model: MilModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, score (0..1), n_sentences, worst_sentence (index from 0; null: no sentence), worst_score.

    One row per row of docs, repeated ones included.  Null and empty texts get
    the leak; of equally bad sentences the first is the worst; long texts are
    scored whole.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most the vocabulary's size
    columns = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name in keep)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        p, doc = sentence_scores(batch.column("text"), shared.value)
        n = batch.num_rows
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n) + np.log1p(-shared.value.leak)
        count = np.bincount(doc, minlength=n)
        start = np.concatenate([[0], np.cumsum(count)])[:-1]
        worst, top = np.full(n, -1), np.full(n, np.nan)
        if len(doc):
            order = np.lexsort((np.arange(len(doc)), -p, doc))
            first = np.flatnonzero(np.diff(doc[order], prepend=-1))
            worst[doc[order][first]] = order[first] - start[doc[order][first]]
            top[doc[order][first]] = p[order][first]
        arrays = [batch.column(k) for k in keep] + [
            pa.array(np.clip(1 - np.exp(none), 0, 1)), pa.array(count.astype(np.int64)),
            pa.array(worst, pa.int64(), mask=worst < 0), pa.array(top, pa.float64(), mask=worst < 0),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=[*keep, "score", "n_sentences", "worst_sentence", "worst_score"])

    return map_arrow(columns, score, f"{kinds}, score double, n_sentences bigint, worst_sentence bigint, worst_score double")


def training_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_docs: int = 2000, sample_chars: int = 20_000) -> tuple[list, np.ndarray, np.ndarray]:
    """Texts, labels and weights of the bounded sample.

    Only rows outside fold 0 are looked at.  Of each class about `sample_docs`
    ids, chosen by a hash; class counts over all labelled ids give the weights
    that undo the even draw.  An id that is labelled both ways counts as toxic;
    of an id's several texts the least, as a string, is learnt from, so the
    sample is bounded however often an id is repeated.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for kind in (0, 1):
        part = sampled(known.where(F.col("toxic") == kind), sample_docs, counts.get(kind, 0), F.col("doc_id").cast("string"))
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = docs.select("doc_id", "text").where(F.length("text") <= sample_chars)
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow()  # about 2 * sample_docs documents
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    toxic = rows.column("toxic").to_numpy().astype(float)
    weights = np.ones(len(toxic))
    for kind in (0, 1):
        n = (toxic == kind).sum()
        weights[toxic == kind] = counts.get(kind, 0) / max(1, n)
    return rows.column("text").to_pylist(), toxic, weights / max(weights.mean(), 1e-9) if len(toxic) else weights


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5, **sample) -> DataFrame:
    """The rows of docs, with their columns, that score below the threshold.

    Null and empty texts have the leak's score and stay; long texts are scored
    whole; repeated rows, null ids and ties at the threshold (which go) are
    judged row by row; any columns may be there.  Without labels of both classes
    all rows score the share of toxic labels.  An empty table gives an empty one.
    """
    texts, toxic, weights = training_sample(docs, labels, folds, **sample)
    plain = masked(docs, "text")
    scored = score_toxicity(plain, fit(texts, toxic, weights), tuple(plain.columns))
    return scored.where(F.col("score") < threshold).select(*plain.columns).toDF(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, **sample) -> DataFrame:
    """Every row of docs with doc_id, held_out, score, predicted and where the worst sentence is.

    Rows with a null id belong to fold crc32('') mod folds; null texts are
    empty ones; repeated rows are each scored.  Long texts are scored whole,
    sentence by sentence (of sampled training documents the first 20,000 characters
    teach).  A score of exactly 0.5 is predicted 1; of equally bad sentences the
    first is named.  Further columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    texts, toxic, weights = training_sample(docs, labels, folds, **sample)
    model = fit(texts, toxic, weights)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_sentence", "worst_score")
