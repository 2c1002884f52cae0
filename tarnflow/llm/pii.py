"""Personal data: base patterns, and a character tagger for what they miss.

The base patterns take the leftmost run and drop it whole if it fails its test,
so neighbouring numbers can hide one another (a phone number and a card number
with a space between are one run of too many digits).  A character-level
BiLSTM-CRF, trained here on labelled spans, reads overlapping windows of every
text.  The windows' emissions are averaged, the more the nearer a character is to
its window's middle, and each unbroken run of windows is decoded as one sequence
under the CRF's transitions, so windows can't disagree.  A tagged span is added if
it overlaps no base span and passes its kind's own test (digits, range, Luhn).
Base spans always stay.

All kinds hold a digit or an "@", so windows without either can't hold a span;
only the others are decoded.  Training windows come from a bounded sample of
documents (`sample_docs`; `most` windows, drawn at random from all of theirs),
labelled by the base patterns, and from generated ones, in which spans of every
kind stand alone and side by side.  All scans of a text are linear in its length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, sampled
from .tagger import BiLstmCrf

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_FOUR = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
LENGTH, STRIDE = 96, 48
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGNS = "@.-+() _%,:/#"
_CLASSES = 6 + len(_SIGNS)

Span = tuple[str, int, int]


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = [d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _small(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _is_card(text: str) -> bool:
    d = _digits(text)
    return 12 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[Span]:
    """The four patterns, each leftmost and non-overlapping within its kind, by start and then kind."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for run in _DOTTED.finditer(text):  # numbers with dots between them, each looked at once; IP alone would be quadratic in digits
        out += [("ip", *m.span()) for m in _FOUR.finditer(text, *run.span()) if _small(m[0].split("."))] if run[0].count(".") > 2 else []
    out += [("card", *m.span()) for m in CARD.finditer(text) if _is_card(m[0])]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def valid(kind: str, text: str) -> bool:
    """What a tagged span must be to count."""
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@<>\"',;:()]+@[^\s@<>\"',;:()]+\.[^\s@<>\"',;:().]{2,}", text))
    if kind == "ip":
        parts = re.split(r"\s?\[?\.\]?\s?", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and _small(parts)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,2}[0-9])+", text)) and _is_card(text)
    return bool(re.fullmatch(r"(?:\+|00 ?|\()[0-9][ ().0-9/-]+[0-9]", text)) and 9 <= len(_digits(text)) <= 15


def symbols(text: str) -> np.ndarray:
    """Class of each code point: 0 is padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(code), 5)
    out[code > 127] = 4
    out[(code >= 48) & (code <= 57)] = 1
    out[(code >= 97) & (code <= 122)] = 2
    out[(code >= 65) & (code <= 90)] = 3
    for k, sign in enumerate(_SIGNS):
        out[code == ord(sign)] = 6 + k
    return out


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that hold a trigger, and their symbols."""
    marks = np.fromiter((m.start() for m in TRIGGER.finditer(text)), np.int64)
    last = max(0, -(-(len(text) - LENGTH) // STRIDE))
    near = np.unique(np.concatenate([marks // STRIDE, marks // STRIDE - 1]))
    near = near[(near >= 0) & (near <= last)] if len(marks) else near[:0]
    padded = np.concatenate([symbols(text), np.zeros(LENGTH, np.int64)])
    starts = near * STRIDE
    return starts, padded[starts[:, None] + np.arange(LENGTH)[None, :]]


_NEAR = (np.minimum(np.arange(LENGTH), np.arange(LENGTH)[::-1]) + 1.0).astype(np.float32)


def joined_emissions(size: int, starts: np.ndarray, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of overlapping windows: first characters, lengths, and all their characters' mean emissions.

    emissions: windows, LENGTH, tags; starts ascending, in steps of STRIDE or more.
    """
    new = np.flatnonzero(np.diff(starts, prepend=-LENGTH - 1) > LENGTH)
    firsts = starts[new]
    ends = np.minimum(starts[np.append(new[1:], len(starts)) - 1] + LENGTH, size)
    lengths = ends - firsts
    # Every window covers LENGTH places of its run; those past the text's end are cut off.
    run = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(starts))))
    begins = np.cumsum(lengths) - lengths
    total = np.zeros((lengths.sum() + LENGTH, emissions.shape[2]), np.float32)
    weight = np.zeros(len(total), np.float32)
    at = begins[run] + starts - firsts[run]
    past = np.minimum(ends[run] - starts, LENGTH)
    for a, n, e in zip(at.tolist(), past.tolist(), emissions):
        total[a : a + n] += e[:n] * _NEAR[:n, None]
        weight[a : a + n] += _NEAR[:n]
    return firsts, lengths, (total / np.maximum(weight, 1e-9)[:, None])[: lengths.sum()]


def tagged_spans(tags: np.ndarray) -> list[Span]:
    """Tags are 0, or 1 + 2 * kind at a span's first character and 2 + 2 * kind within."""
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    first = (tags > 0) & (tags % 2 == 1)
    change = np.flatnonzero(np.diff(kind, prepend=-1) | first)
    ends = np.append(change[1:], len(tags))
    return [(KINDS[kind[a]], a, b) for a, b in zip(change.tolist(), ends.tolist()) if kind[a] >= 0]


def _tags(model: BiLstmCrf, texts: list[tuple[int, np.ndarray, np.ndarray]]) -> list[list[Span]]:
    """Tagged spans per text (size, starts, symbols of the windows)."""
    x = np.concatenate([t[2] for t in texts])
    e = np.concatenate([model.emissions(x[a : a + 512]).transpose(1, 0, 2).astype(np.float32) for a in range(0, len(x), 512)])
    runs, done = [], 0
    for size, starts, own in texts:
        runs.append(joined_emissions(size, starts, e[done : done + len(own)]))
        done += len(own)
    tags = model.best(np.concatenate([r[2] for r in runs]), np.concatenate([r[1] for r in runs]))
    out, done = [], 0
    for firsts, lengths, _ in runs:
        spans: list[Span] = []
        for first, n in zip(firsts.tolist(), lengths.tolist()):
            spans += [(kind, first + a, first + b) for kind, a, b in tagged_spans(tags[done : done + n])]
            done += n
        out.append(spans)
    return out


def find(texts: list[str | None], model: BiLstmCrf | None, together: int = 2048) -> list[tuple[list[Span], list[Span]]]:
    """Per text its base spans and the added ones; about `together` windows are tagged at once, or one text's."""
    out: list[tuple[list[Span], list[Span]]] = []
    waiting: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def settle():
        for (n, *_), spans in zip(waiting, _tags(model, [w[1:] for w in waiting])):
            text, (base, added) = texts[n], out[n]
            fixed = iter(sorted((a, b) for _, a, b in base))
            taken = [next(fixed, (len(text), len(text)))]
            for kind, start, end in spans:
                while end > start and text[end - 1] in " .,;:":
                    end -= 1
                while start < end and text[start] in " .,;:":
                    start += 1
                # Base spans that may still overlap: both lists ascend.
                while taken[-1][0] < end:
                    taken.append(next(fixed, (len(text), len(text))))
                taken = [x for x in taken if x[1] > start]
                if valid(kind, text[start:end]) and not any(a < end and start < b for a, b in taken):
                    added.append((kind, start, end))
        waiting.clear()

    for n, text in enumerate(texts):
        if not text or not TRIGGER.search(text):
            out.append(([], []))
            continue
        out.append((base_spans(text), []))
        if model is not None:
            waiting.append((n, len(text), *windows(text)))
            if sum(len(w[2]) for w in waiting) >= together:
                settle()
    if waiting:
        settle()
    return out


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _made(kind: str, rng: np.random.Generator) -> str:
    word = lambda n: "".join(chr(97 + k) for k in rng.integers(0, 26, n))
    if kind == "email":
        name = word(int(rng.integers(2, 9))) + rng.choice(["", "." + _number(rng, 2), "_" + word(4), "-" + word(3), "." + word(5)])
        return f"{name}@{word(int(rng.integers(3, 9)))}{rng.choice(['', _number(rng, 1), '.' + word(4)])}.{rng.choice(['com', 'org', 'net', 'io', 'de', 'co.uk'])}"
    if kind == "ip":
        return ".".join(str(k) for k in rng.integers(1, 256, 4))
    if kind == "card":
        body = [int(k) for k in rng.integers(0, 10, int(rng.choice([14, 15, 15, 15, 18])))]
        body[0] = int(rng.integers(3, 7))
        check = next(k for k in range(10) if luhn([*body, k]))
        digits = "".join(map(str, [*body, check]))
        gap = str(rng.choice(["", "", " ", "-", "."]))
        return gap.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    country = str(rng.integers(1, 99))
    forms = [f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country}{a}{b}{c}", f"({a}) {b}-{c}", f"00{country} {a} {b}{c}"]
    return str(rng.choice(forms))


def training_windows(texts: list[str], generated: int = 1200, seed: int = 11, most: int = 900) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags: windows of the texts by their base spans, and generated ones."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def put(text: str, spans: list[Span], starts: np.ndarray, x: np.ndarray) -> None:
        tags = np.zeros(len(text) + LENGTH, np.int64)
        for kind, a, b in spans:
            tags[a:b] = 2 + 2 * KINDS.index(kind)
            tags[a] -= 1
        xs.extend(x)
        ys.extend(tags[s : s + LENGTH] for s in starts)

    found = [windows(text) for text in texts]
    of = np.repeat(np.arange(len(texts)), [len(starts) for starts, _ in found])
    nth = np.concatenate([np.arange(len(starts)) for starts, _ in found]) if found else of
    pick = np.sort(rng.choice(len(of), min(most, len(of)), replace=False))
    for n in np.unique(of[pick]).tolist():
        own = nth[pick[of[pick] == n]]
        put(texts[n], base_spans(texts[n]), found[n][0][own], found[n][1][own])
    words = [w for t in texts for w in t.split()]
    filler = [words[k] for k in rng.integers(0, len(words), 5000)] if words else "the of and to in that for with from this".split()
    some = lambda n: " ".join(filler[k] for k in rng.integers(0, len(filler), n))
    while len(xs) < most + generated:
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += some(int(rng.integers(0, 7))) + " "
            if rng.random() < 0.25:
                text += str(rng.choice([_number(rng, int(rng.integers(1, 9))), f"20{_number(rng, 2)}-0{_number(rng, 1)}-1{_number(rng, 1)}", f"{_number(rng, 2)}.{_number(rng, 2)}", "AKIA" + "X7Q2" * 3, "%x" % rng.integers(1 << 40, 1 << 60)])) + " "
                continue
            for kind in rng.choice(KINDS, 1 + int(rng.random() < 0.5)):
                made = _made(str(kind), rng)
                spans.append((str(kind), len(text), len(text) + len(made)))
                text += made + str(rng.choice([" ", " ", " ", ". ", ", ", "\n"]))
        text += some(8)
        starts, x = windows(text)
        put(text, spans, starts, x)
    return np.array(xs), np.array(ys)


def train(docs: DataFrame, sample_docs: int = 300, look_at: int = 6000, epochs: int = 8) -> BiLstmCrf:
    """The tagger, from a bounded sample.

    Of about `look_at` documents, chosen by a hash of their id, at most
    `sample_docs` that hold a trigger and have 20,000 characters at most; of
    these documents' windows at most 900, drawn at random, and generated ones
    up to 2100 in all.  Without documents the generated ones are all.
    """
    key = F.col("doc_id").cast("string") if "doc_id" in docs.columns else F.col("text")
    drawn = sampled(docs, look_at, docs.count(), key).select("text", F.xxhash64(key).alias("_h"))
    held = drawn.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= 20_000))
    texts = [r["text"] for r in held.orderBy("_h", "text").limit(sample_docs).collect()]
    x, y = training_windows(texts)
    model = BiLstmCrf(_CLASSES, 1 + 2 * len(KINDS), kind=np.float32)
    model.fit(x, y, epochs)
    return model


_SPAN = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("added", "boolean")


def find_personal_data(docs: DataFrame, model: BiLstmCrf | None = None) -> DataFrame:
    """docs with spans: array of kind, start, end (code points, end exclusive), added.

    Spans are by start, then kind.  Null and empty texts have none; long texts
    are read whole.  The table may have any columns; one named `spans` is
    replaced.  Repeated rows stay, null ids are ids like any other, and an empty
    table gives no rows.
    """
    model = model or train(docs)
    docs = docs.drop("spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    order = {k: n for n, k in enumerate(KINDS)}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(_SPAN))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find(batch.column("text").to_pylist(), shared.value)
        rows = []
        for base, added in found:
            all_ = [(*s, False) for s in base] + [(*s, True) for s in added]
            rows.append([{"kind": k, "start": a, "end": b, "added": new} for k, a, b, new in sorted(all_, key=lambda s: (s[1], order[s[0]]))])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "spans"])

    return map_arrow(docs, run, schema)


def personal_data(docs: DataFrame, model: BiLstmCrf | None = None) -> DataFrame:
    """The digest: doc_id, n_email, n_ip, n_card, n_phone, n_base_email, ..., base_sha256, spans, n_added.

    n_{kind} counts all spans, n_base_{kind} those of the base patterns alone.
    Null and empty texts have no spans (the digest of nothing); long texts are
    searched whole, their overlapping windows decoded at once.  Where a base span
    and an added one overlap, the base one stays; of spans that begin together the
    kind listed first comes first.  Repeated rows give repeated results, a null id
    stays null, further columns are ignored, an empty table gives no rows.
    """
    model = model or train(docs)
    found = find_personal_data(docs.select("doc_id", "text"), model)
    text = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda s, k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: ~x["added"])
    return found.select(
        "doc_id", *(count("spans", k).alias(f"n_{k}") for k in KINDS), *(count(base, k).alias(f"n_base_{k}") for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["added"])).cast("long").alias("n_added"),
    )


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """Each span replaced by its kind in brackets; overlapping ones by the first's."""
    if not text:
        return text
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: BiLstmCrf | None = None) -> DataFrame:
    """docs with all spans replaced in text, and n_chars, where there is one, to match.

    All rows and columns stay, whatever their names; null and empty texts stay
    as they are, long ones are read whole; repeated rows are each redacted; an
    empty table gives an empty one.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    order = {k: n for n, k in enumerate(KINDS)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = find(texts, shared.value)
        new = [redacted(t, sorted(a + b, key=lambda s: (s[1], order[s[0]]))) for t, (a, b) in zip(texts, found)]
        at = batch.schema.names.index("text")
        columns = list(batch.columns)
        columns[at] = pa.array(new, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = map_arrow(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
