"""Token counts by section: offset-mapped attribution.

Sections are sentences unless told otherwise.  Most vocabularies put the space
before a word into the word's token, so the first token of nearly every sentence
begins in the one before it.

A text is encoded once, as a whole, so tokens may cross section boundaries as
they do in training.  Tokens have character spans; sections are intervals that
tile the text; the interval join of the two is a merge of sorted boundaries.  A
token inside one section counts there.  A token that crosses boundaries is
given by an explicit rule:

* `majority`: to the section that holds most of its characters, the earlier on a tie;
* `start`: to the section of its first character;
* `split`: to each section in proportion to its characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow
from .tokens import default_tokenizer, tokenizer

RULES = ("majority", "start", "split")
#: A line break, or a whole run of marks and what closes them, with the blanks after it: each character is read once.
_END = re.compile(r"\n|[.!?\"')\]]++[ \t]*+")
_MARK = re.compile(r"[.!?]")


def sentences(text: str) -> np.ndarray:
    """First characters of the sentences: the text's, and those after each line break and after an end mark with its space."""
    ends = np.fromiter((m.end() for m in _END.finditer(text) if m[0] == "\n" or (m[0][-1] in " \t" and _MARK.search(m[0]))), np.int64)
    return np.concatenate([[0], ends[ends < len(text)]]).astype(np.int64)


def lines(text: str) -> np.ndarray:
    """First characters of the lines; a line break belongs to the line that it ends."""
    at = [0]
    i = text.find("\n")
    while 0 <= i < len(text) - 1:
        at.append(i + 1)
        i = text.find("\n", i + 1)
    return np.array(at, np.int64)


def attribute(first: np.ndarray, last: np.ndarray, begins: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens' shares and crossing tokens per section."""
    ends = np.append(begins[1:], size)
    n = len(begins)
    a = np.searchsorted(begins, first, side="right") - 1
    b = np.searchsorted(begins, np.maximum(last - 1, first), side="right") - 1
    within = a == b
    count = np.bincount(a[within], minlength=n).astype(float)
    crossing = np.zeros(n, np.int64)
    t = np.flatnonzero(~within)
    if not len(t):
        return count, crossing
    # Each crossing token with each section that it touches.
    pieces = b[t] - a[t] + 1
    first_of = np.cumsum(pieces) - pieces
    token = np.repeat(t, pieces)
    s = a[token] + np.arange(len(token)) - np.repeat(first_of, pieces)
    chars = np.minimum(ends[s], last[token]) - np.maximum(begins[s], first[token])
    crossing += np.bincount(s, minlength=n)
    if rule == "start":
        count += np.bincount(a[t], minlength=n)
    elif rule == "majority":
        most = np.maximum.reduceat(chars, first_of)
        order = np.flatnonzero(chars == np.repeat(most, pieces))
        _, earliest = np.unique(token[order], return_index=True)
        count += np.bincount(s[order[earliest]], minlength=n)
    else:
        count += np.bincount(s, chars / np.repeat(np.add.reduceat(chars, first_of), pieces), n)
    return count, crossing


def token_counts(docs: DataFrame, sections: Callable[[str], np.ndarray] = sentences, rule: str = "majority", path: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, section, start, end, n_tokens, n_crossing, doc_tokens.

    `start` and `end` are characters (code points), end exclusive.  Over a
    document n_tokens sums to doc_tokens under every rule.  Null and empty
    texts have one empty section with no tokens.  Long texts are encoded whole.
    Repeated rows give repeated results; further columns are ignored; an empty
    table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_tokenizer()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(path)
        row, columns = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            text = text or ""
            ids, first, last = bpe.spans(text)
            begins = sections(text)
            count, crossing = attribute(first, last, begins, len(text), rule)
            n = len(begins)
            row.append(np.full(n, i))
            columns.append((np.arange(n), begins, np.append(begins[1:], len(text)), count, crossing, np.full(n, len(ids))))
        parts = [np.concatenate(x) for x in zip(*columns)]
        counted = pa.array(parts[3]) if rule == "split" else pa.array(parts[3].astype(np.int64))
        arrays = [batch.column("doc_id").take(pa.array(np.concatenate(row))), pa.array(parts[0].astype(np.int32)), pa.array(parts[1]), pa.array(parts[2]), counted, pa.array(parts[4]), pa.array(parts[5])]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    number = "double" if rule == "split" else "long"
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, section int, start long, end long, n_tokens {number}, n_crossing long, doc_tokens long")
