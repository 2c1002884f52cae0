"""Text operators against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnflow.llm import attribution, classlm, common, mixing, packing, pii, simhash, substring, tagger, tokens, toxicity
from tarnflow.llm import queries as llm_queries
from tarnflow.llm.components import connected_components

from .helpers import DOCS, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in enumerate(texts)], DOCS)


# Shared helpers -----------------------------------------------------------------------------


def test_words_are_split_on_six_characters_only():
    texts = [" a\tb\x0bc\x0cd\re\nf ", None, "", "x y z \x1c", "ÄBc"]
    flat, offsets = common.split_words(pa.array(texts, pa.string()))
    got = [flat[offsets[i] : offsets[i + 1]].to_pylist() for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    assert common.split_words(pa.array(["ÄBc"]), lower=True)[0].to_pylist() == ["Äbc"]


def test_slices_are_split_as_whole_arrays_are():
    texts = [" ".join(f"Word{i} x{k}" for k in range(i % 7)) for i in range(300)]
    for lower in (False, True):
        for a in (0, 1, 137, 299):
            flat, offsets = common.split_words(pa.array(texts).slice(a, 90), lower)
            want = [(t.lower() if lower else t).split() for t in texts[a : a + 90]]
            assert [flat[offsets[i] : offsets[i + 1]].to_pylist() for i in range(len(want))] == want


def test_string_hashes_depend_on_the_string_alone():
    words = ["", "a", "b", "ab", "ba", "a" * 50, "é", "漢"]
    a = common.string_hashes(pa.array(words))
    assert len(set(a.tolist())) == len(words)
    assert (common.string_hashes(pa.array(["x", *words]).slice(1)) == a).all()
    assert len(common.string_hashes(pa.array([], pa.string()))) == 0


def test_slices_cover_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 9, 100, 1)]), pa.array(range(5))], names=["text", "k"])
    parts = list(common.slices(batch, limit=10))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(5)) and len(parts) > 2


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["root"] for r in out.collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(30))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substring dedup ----------------------------------------------------------------------------


def brute_repeats(rows, window=13):
    by_id: dict = {}
    first: dict = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        by_id.setdefault(i, []).append(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    out = Counter()
    for i, lists in by_id.items():
        for w in lists:
            gone = [False] * len(w)
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < (math.inf if i is None else i):
                    gone[k : k + window] = [True] * window
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            out[(i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [2, 4096])
def test_repeats_match_brute_force(spark, hot):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        a = rng.randint(0, 40)
        t += passage[a : a + rng.randint(5, 40)] * rng.randint(1, 2)
        texts.append(" ".join(t + [rng.choice(words) for _ in range(rng.randint(0, 20))]))
    texts += texts[:5] + [None, "", "a " * 12, "a " * 40, "a " * 40]
    df = docs_of(spark, texts)
    out = substring.remove_repeats(df, hot=hot).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out)
    assert got == brute_repeats(list(enumerate(texts)))
    for r in out:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_repeats_on_awkward_and_empty_tables(spark):
    df = awkward(spark)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring.remove_repeats(df).collect())
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in df.collect()])
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_windows_in_two_documents_are_confirmed():
    of, nth, owner = substring.confirm([b"a b c d", b"a b c e", b"x y z"], np.array([4, 2, 7]), np.array([9, 2, 7]), 3)
    assert list(zip(of.tolist(), nth.tolist(), owner.tolist())) == [(0, 0, 2), (0, 1, 4), (1, 0, 2)]


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_automata_find_what_no_other_step_says(limit, monkeypatch):
    """One occurrence of each passage is known; the documents hold more of them."""
    monkeypatch.setattr(substring, "AUTOMATON", limit)
    rng = random.Random(2)
    lists = [[rng.choice("abc") + rng.choice(["", "é", "bc"]) for _ in range(rng.randint(0, 60))] for _ in range(40)]
    table = pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": [" ".join(x) for x in lists]})
    block = substring.read_block(table)
    spots: dict = {}
    for d, own in enumerate(lists):
        for k in range(len(own) - 3):
            spots.setdefault(tuple(own[k : k + 4]), []).append((int(block.offsets[d]) + k, d))
    chosen = sorted((spots[w][-1][0], spots[w][0][1]) for w in sorted(spots)[::3])  # the last occurrence, the first document
    first, owner = (np.array(x) for x in zip(*chosen))
    recurs, gone = substring.locate(block, np.arange(len(first)), first, owner, 4)
    want = np.zeros((2, len(block.word)), bool)
    for w in sorted(spots)[::3]:
        for at, d in spots[w]:
            want[0, at : at + 4] = True
            want[1, at : at + 4] |= spots[w][0][1] < d
    assert (recurs == want[0]).all() and (gone == want[1]).all() and gone.any()
    monkeypatch.setattr(substring.Stream, "matches", lambda self, passages: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not substring.locate(block, np.arange(len(first)), first, owner, 4)[0].any()


# SimHash ------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, fps):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprints_and_components_match_brute_force(spark):
    df = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = Counter(zip((d for d, _ in rows), (f"{f:016x}" for f in fps), brute_components(rows, fps)))
    assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("cell", [4096, 8])
def test_links_connect_what_all_pairs_would(spark, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = set(rng.integers(0, 1 << 63, 60, dtype=np.uint64).tolist())
    for b in base.tolist():
        for _ in range(25):
            fp.add(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)))
    fp = sorted(fp)
    signed = np.array(fp, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    want = brute_components([(x, "") for x in signed], fp)
    assert [got.get(x, x) for x in signed] == want
    for r in edges.collect():
        assert r["a"] != r["b"]


def test_pivot_differences_never_exceed_the_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    gap = np.abs(simhash.pivot_table(a).astype(int) - simhash.pivot_table(b).astype(int)).max(axis=1)
    assert (gap <= np.bitwise_count(a ^ b)).all()


def test_keep_one_keeps_the_smallest_id_and_all_columns(spark):
    df = awkward(spark)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    fps = [brute_fingerprint(r["text"]) for r in df.collect()]
    groups = len(set(brute_components([(k, "") for k in range(len(fps))], fps)))
    assert len(rows) == groups and {r["score"] for r in rows} == {7}
    assert 6 in {r["doc_id"] for r in rows} and 7 not in {r["doc_id"] for r in rows}


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_keep_one_keeps_one_of_equal_rows(spark, threshold):
    data = [(5, "a b c d e", "en", "s", 1)] * 4 + [(5, "a b c d e", "en", "t", 1), (9, "a b c d e", "en", "s", 1), (None, "x y z", "en", "s", 1), (None, "x y z", "en", "s", 1), (2, "q r s", "en", "s", 1)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for rows in (data, data[::-1]):
            kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
            assert sorted(r[0] or 0 for r in kept) == [0, 2, 5] and set(kept) <= set(data)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# Toxicity -----------------------------------------------------------------------------------


def toxic_corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "san") for b in ("do", "ren", "ti", "vu", "xo", "pal")]
    texts, labels = [], []
    for k in range(n):
        s = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 8))]
        bad = k % 4 == 0
        if bad:
            i = rng.randrange(len(s))
            s[i] += rng.choice([" rotten", " VILE!!", " vilest"])
        texts.append(". ".join(s) + ".")
        labels.append(int(bad))
    return texts, np.array(labels)


def test_sentence_model_finds_documents_and_sentences():
    texts, labels = toxic_corpus()
    model = toxicity.fit(texts[:300], labels[:300])
    p, doc = toxicity.sentence_scores(pa.array(texts[300:]), model)
    score = 1 - np.exp(np.bincount(doc, np.log1p(-p), 100) + np.log1p(-model.leak))
    assert ((score >= 0.5) == labels[300:]).mean() > 0.97
    for i in np.flatnonzero(labels[300:]):
        own = np.flatnonzero(doc == i)
        said = texts[300 + i].split(".")[int(p[own].argmax())].lower()
        assert "rotten" in said or "vil" in said


def test_scores_are_the_noisy_or_of_sentences(spark):
    """Recomputed sentence by sentence from the model's weights."""
    texts, labels = toxic_corpus(120)
    model = toxicity.fit(texts, labels)
    texts += ["", "Vile.\nrotten, words! no end", "  \n ", "... !!!"]
    weight = dict(zip(model.features, model.weights))

    def plain(text):
        miss, sentence = 1 - model.leak, set()
        line = WORD.findall(text.replace("\n", " \x1e "))  # a line break ends a sentence, be it empty
        for k, w in enumerate(line):
            if w != "\x1e":
                sentence.add(w.lower())
            if w == "\x1e" or re.search(r"[.!?]\W*$", w) or k == len(line) - 1:
                clean = [re.sub(r"^\W+|\W+$", "", x) for x in sentence]
                z = model.bias + sum(weight.get(f, 0.0) for x in set(clean) for f in (x, *(f"{n}:{x[:n]}" for n in (4, 5) if len(x) >= n)))
                miss *= 1 - 1 / (1 + math.exp(-z))
                sentence = set()
        return 1 - miss

    out = toxicity.score_toxicity(docs_of(spark, texts), model).collect()
    got = {r["doc_id"]: r["score"] for r in out}
    for i in (*range(120), 120, 121, 122, 123):
        assert got[i] == pytest.approx(plain(texts[i]), abs=1e-9)
    assert got[120] == pytest.approx(model.leak)


def test_labels_that_contradict_and_ids_that_repeat(spark):
    df = docs_of(spark, ["b", "a", "c"]).union(docs_of(spark, ["a"] * 3).withColumn("doc_id", F.lit(1).cast("long")))
    ids = [i for i in range(3) if zlib.crc32(str(i).encode()) % 5]
    known = spark.createDataFrame([(i, 1, x) for i in ids for x in (0, 1)], "doc_id long, quality int, toxic int")
    texts, toxic, _ = toxicity.training_sample(df, known)
    assert texts == [["b", "a", "c"][i] for i in ids] and toxic.tolist() == [1.0] * len(ids)


def test_toxicity_scores_every_row(spark):
    texts, labels = toxic_corpus(200)
    df = docs_of(spark, texts).unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    known = spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(labels)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(df.withColumn("score", F.lit(1)), known).collect()
    assert len(out) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in out)
    kept = toxicity.drop_toxic(awkward(spark), known)
    assert kept.columns == awkward(spark).columns and kept.count() == 15
    assert toxicity.toxicity(empty(spark), known).count() == 0
    assert max(r["score"] for r in toxicity.toxicity(df, known.limit(0)).collect()) < 0.01


# Personal data ------------------------------------------------------------------------------


def brute_spans(text):
    out = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in pii.CARD.finditer(text) if 12 <= len(re.sub(r"\D", "", m[0])) <= 19 and pii.luhn([int(c) for c in re.sub(r"\D", "", m[0])])]
    out += [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_match_plain_searches():
    rng = random.Random(9)
    pieces = ["a@b.c", "@", "x.y", "1.2.3.4", "300.1.1.1", "4524132264652876", "+1 (269) 555-3296", " ", "-", "é", "..", "a", "9", "@b.com", "z@", "\n", "+", "00"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("1" * 6000 + ".1.1.1") == []


def test_gradients_of_the_tagger():
    model = tagger.BiLstmCrf(7, 5, hidden=3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 7, (4, 6)), rng.integers(0, 5, (4, 6))
    _, grad = model.loss(x, y)
    for name, a in model.p.items():
        for at in [tuple(rng.integers(0, s) for s in a.shape) for _ in range(4)]:
            old = a[at]
            a[at] = old + 1e-5
            up = model.loss(x, y)[0]
            a[at] = old - 1e-5
            down = model.loss(x, y)[0]
            a[at] = old
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7)


def test_viterbi_is_the_best_of_all_rows():
    model = tagger.BiLstmCrf(4, 3, hidden=2, seed=1)
    model.p["move"] = np.random.default_rng(2).normal(size=(3, 3))
    x = np.array([[0, 1, 2, 3]])
    rows = np.array(np.meshgrid(*[range(3)] * 4)).reshape(4, -1).T
    nll = [model.loss(x, r[None, :])[0] for r in rows]
    assert (model.decode(x)[0] == rows[int(np.argmin(nll))]).all()


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(3)
    filler = [" ".join(rng.choice(["the", "of", "onder", "thent", "eau", "ciónra"]) for _ in range(60)) for _ in range(20)]
    x, y = pii.training_windows(filler, generated=1200)
    model = tagger.BiLstmCrf(pii._CLASSES, 1 + 2 * len(pii.KINDS), kind=np.float32)
    losses = model.fit(x, y, 8)
    assert losses[-1] < 0.5 * losses[0]
    return model


def test_tagger_is_accurate_on_windows_it_has_not_seen(trained):
    x, y = pii.training_windows(["the onder of thent"] * 3, generated=300, seed=77)
    got = trained.decode(x)
    assert (got == y).mean() > 0.97 and ((got > 0) == (y > 0))[y > 0].mean() > 0.85


def test_personal_data_keeps_base_and_adds_only_valid_spans(spark, trained):
    df = awkward(spark)
    found = pii.find_personal_data(df, trained)
    assert found.columns == [*(c for c in df.columns if c != "spans"), "spans"]
    for r in found.collect():
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["added"]]
        assert base == brute_spans(r["text"] or "")
        for s in r["spans"]:
            if s["added"]:
                assert pii.valid(s["kind"], r["text"][s["start"] : s["end"]])
    digest = pii.personal_data(df, trained).collect()
    want = Counter(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(r["text"] or "")).encode()).hexdigest() for r in df.collect())
    assert Counter(r["base_sha256"] for r in digest) == want
    assert all(len([x for x in r["spans"].split(",") if x]) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in digest)
    out = pii.redact(df, trained)
    assert out.columns == df.columns and any("[EMAIL]" in (r["text"] or "") for r in out.collect())
    assert pii.redact(empty(spark)).count() == 0
    assert pii.redacted("ab cd", [("ip", 0, 2), ("card", 1, 4)]) == "[IP]d"


def test_personal_data_query_counts_base_spans_alone(spark, trained, tmp_path, monkeypatch):
    """Numbers side by side, of which the tagger finds more than the base patterns: the counts don't follow it."""
    texts = [f"onder thent {a}{gap}{b} the of" for a in ("+1 (269) 555-3296", "bob.42@example.com") for b in ("4524132264652876", "4539 1488 0343 6467", "8.8.4.4") for gap in (" ", "-", ", ")] + ["", None]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(pii, "train", lambda docs: trained)
    rows = {r["doc_id"]: r for r in llm_queries.op6_personal_data(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) and sum(r["n_added"] for r in rows.values()) > 0
    for k, text in enumerate(texts):
        base = brute_spans(text or "")
        assert [rows[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(s[0] == kind for s in base) for kind in pii.KINDS]
        assert rows[k]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest()
        assert len([x for x in rows[k]["spans"].split(",") if x]) == len(base) + rows[k]["n_added"]


def test_windows_cover_every_trigger():
    text = "x" * 500 + "9" + "y" * 300 + "@" + "z" * 40
    starts, x = pii.windows(text)
    for at in (500, 801):
        assert any(s <= at < s + pii.LENGTH for s in starts)
    tags = np.zeros(x.shape, int)
    for k, s in enumerate(starts):
        if s <= 500 < s + pii.LENGTH:
            tags[k, 500 - s] = 1
    emissions = np.eye(9)[tags]
    firsts, lengths, mean = pii.joined_emissions(len(text), starts, emissions)
    assert lengths.sum() == len(mean) and (firsts + lengths <= len(text)).all()
    found = [(k, f + a, f + b) for f, n, begin in zip(firsts, lengths, np.cumsum(lengths) - lengths) for k, a, b in pii.tagged_spans(mean[begin : begin + n].argmax(axis=1))]
    assert found == [("email", 500, 501)]


def test_a_million_digits_take_seconds():
    text = "1" * 1_000_000 + " " + "1.2.3.4" * 1000 + " " + "9" * 500_000 + ".1.1.1 8.8.8.8 " + "+1(" * 1000 + "7" * 1000 + "-" * 1000
    begun = time.time()
    spans = pii.base_spans(text)
    assert time.time() - begun < 10 and ("ip", text.index("8.8.8.8"), text.index("8.8.8.8") + 7) in spans
    short = "1" * 300 + " " + "1.2.3.4" * 100 + "9" * 200 + ".1.1.1 8.8.8.8.8.8.8.8.8"
    assert [s for s in pii.base_spans(short) if s[0] == "ip"] == [s for s in brute_spans(short) if s[0] == "ip"]
    model = tagger.BiLstmCrf(pii._CLASSES, 1 + 2 * len(pii.KINDS), kind=np.float32)
    assert len(pii.find(["1" * 200_000, "a@b.c"], model)) == 2 and time.time() - begun < 60


def test_windows_do_not_disagree(trained):
    """Wherever a span lies among the windows, it is found whole or not at all: one decoding over all of them."""
    number = "4539 1488 0343 6467"
    found = 0
    for k in range(0, 96, 7):
        text = "onder thent " * 12 + "x" * k + " +1 (269) 555-3296 " + number + " onder " * 20
        base, added = pii.find([text], trained)[0]
        found += any(text[a:b] == number for _, a, b in base + added)
        assert all(pii.valid(kind, text[a:b]) for kind, a, b in added)
    assert found >= 10


def test_added_spans_on_planted_data(trained):
    """Spans side by side, as the base patterns lose them: what the tagger finds of these, and what else it says."""
    rng = np.random.default_rng(123)
    missed = hit = wrong = 0
    for _ in range(300):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += " ".join(rng.choice(["the", "of", "onder", "thent", "eau", "2024", "17", "3.14"], int(rng.integers(2, 9)))) + " "
            for kind in rng.choice(pii.KINDS, 2):
                made = pii._made(str(kind), rng)
                spans.append((str(kind), len(text), len(text) + len(made)))
                text += made + " "
        base, added = pii.find([text + "onder thent"], trained)[0]
        rest = {s for s in spans if s not in base}
        missed += len(rest)
        hit += len(rest & set(added))
        wrong += len(set(added) - set(spans))
    print(f"planted spans that base patterns miss: {missed}, found {hit}, others {wrong}")
    assert hit / missed > 0.5 and hit / (hit + wrong) > 0.8


# Mixing -------------------------------------------------------------------------------------


def test_mix_meets_its_targets_and_repeats(spark):
    rng = random.Random(8)
    sizes = [rng.choice([1, 2, 5, 9, 30, 70, 200]) for _ in range(1500)]
    sizes[::250] = [9_000] * 6  # outliers, each longer than a source's other documents may gain or lose by rounding
    sources = [rng.choice(["a", "b", "c", "a", None]) for _ in sizes]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), "en", s, 0) for i, (n, s) in enumerate(zip(sizes, sources))], DOCS)
    out = mixing.mix(df).toPandas()
    assert len(out) == 1500 and (out.taken <= 3 * out["size"]).all() and (out.taken % out["size"] == 0).all()
    assert out.sort_values("doc_id")["size"].tolist() == sizes
    per = out.groupby(out.source.fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"), source_size=("source_size", "first"))
    assert (per["size"] == per.source_size).all() and per.target.sum() == pytest.approx(per["size"].sum())
    assert (abs(per.taken - per.target) <= 4).all()
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_sources_of_the_test_tables_come_within_one_percent(spark):
    out = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    per = out.groupby(out.source.fillna("~")).agg(n=("size", "count"), target=("target", "first"), taken=("taken", "sum"))
    large = per[per.n >= 50]
    assert len(large) and (abs(large.taken / large.target - 1) < 0.01).all()


@pytest.mark.parametrize("reserve", [64, 2])
def test_mix_expectation_is_each_documents_share(spark, reserve, monkeypatch):
    monkeypatch.setattr(mixing, "RESERVE", reserve)
    monkeypatch.setattr(mixing, "FAN", 2)
    sizes = (1, 1, 2, 3, 5, 8, 8, 13, 21, 40, 300)
    # Many sources with the same sizes: the even ones are wanted 1.2 times, the odd ones 0.8 times.
    data = [(i * 100 + k, "w " * n, "en", f"{i:04d}", 0) for i in range(800) for k, n in enumerate(sizes)]
    out = mixing.mix(spark.createDataFrame(data, DOCS), weights=(3, 2)).toPandas()
    out["wanted"] = out.target / out.source_size
    for (_, wanted), own in out.groupby([out.doc_id % 100, out.wanted.round(6)]):
        assert wanted == pytest.approx(1.2) or wanted == pytest.approx(0.8)
        assert abs(own.copies.mean() - wanted) < 4 * own.copies.std() / math.sqrt(len(own))  # standard errors


def test_repeated_rows_are_rounded_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    same = [(7, "a b c", "en", "s", 5)] * 500
    df = spark.createDataFrame([*same, (8, "x " * 3000, "en", "t", 1), (7, "c b a", "en", "s", 5)], DOCS)
    mixed = mixing.mix(df)
    rows = mixed.where("source = 's'").toPandas()
    assert len(rows) == 501 and abs(rows.taken.sum() - rows.target.iloc[0]) <= 3 and rows.copies.max() - rows.copies.min() <= 1
    out = mixing.apply_mix(df).groupBy("text").count().toPandas().set_index("text")["count"]
    assert out["a b c"] + out["c b a"] == rows.copies.sum() and out["c b a"] in (rows.copies.min(), rows.copies.max())


def test_targets_are_water_filling(spark):
    sizes = {"a": 1, "b": 100, "c": 1000, "d": 0, None: 7}
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(sizes.items())], "doc_id int, source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    order = [*sorted(s for s in sizes if s), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, open_, rest = {}, list(order), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > 3 * sizes[s]]
        if not over:
            want |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            rest -= want[s]
            open_.remove(s)
    assert got == pytest.approx(want)


def test_mix_and_apply_on_awkward_tables(spark):
    df = awkward(spark)
    mixed = mixing.mix(df)
    rows = mixed.collect()
    assert len(rows) == df.count()
    out = mixing.apply_mix(df)
    assert out.columns == df.columns and abs(sum(r["taken"] for r in rows) - mixing.sized(out).groupBy().sum("size").collect()[0][0]) <= 60_000
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
    assert mixing.mix(empty(spark)).count() == 0 and mixing.apply_mix(empty(spark)).count() == 0
    nothing = docs_of(spark, [None, ""])
    assert {(r["target"], r["taken"]) for r in mixing.mix(nothing).collect()} == {(0.0, 0)}


# Tokens -------------------------------------------------------------------------------------


def test_ids_and_offsets_are_the_tokenizers_own():
    bpe = tokens.tokenizer(tokens.default_tokenizer())
    rng = random.Random(4)
    texts = ["", "a", " Hello  world\n\n x", "<|endoftext|> here", "漢字🙂é", "\x00\x1c ", "a" * 3000, " " * 500, "don't we'll 123,456 !!!"]
    texts += ["".join(chr(rng.choice([32, 10, 65, 97, 233, 0x4E00, 0x1F600, 48, 39, 9])) for _ in range(rng.randint(1, 80))) for _ in range(300)]
    for text in texts:
        e = bpe.slow.encode(text, add_special_tokens=False)
        ids, first, last = bpe.spans(text)
        assert ids.tolist() == e.ids
        assert list(zip(first.tolist(), last.tolist())) == [tuple(o) for o in e.offsets], text


def test_pieces_and_packing(spark):
    rng = random.Random(6)
    texts = ["word " * rng.choice([1, 10, 100, 500, 1023, 1024, 1025, 3000]) for _ in range(120)] + [None, ""]
    df = docs_of(spark, texts)
    out = packing.pack_documents(df, keep_ids=True).toPandas()
    bpe = tokens.tokenizer(tokens.default_tokenizer())
    for i, t in enumerate(texts):
        ids = [*bpe.encode(t or ""), 2]
        own = out[out.doc_id == i].sort_values("piece")
        assert [x for part in own.ids for x in part] == ids and own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist()
        assert (own.length.iloc[1:] == 1024).all() and all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(own.ids, own.ids_crc32))
    by = out.sort_values("offset").groupby("sequence_id")
    assert (by.length.sum() <= 1024).all() and ((by.length.cumsum() - out.sort_values("offset").length) == out.sort_values("offset").offset).all()
    assert out.sequence_id.nunique() <= math.ceil(out.length.sum() / 1024) * 1.05 + 2
    whole = packing.sequences(packing.pack_documents(df, keep_ids=True)).toPandas()
    assert sum(map(len, whole.ids)) == out.length.sum()
    assert packing.pack_documents(awkward(spark)).count() >= 15 and packing.pack_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_every_capacity_holds(rule):
    lengths = np.sort(np.random.default_rng(1).integers(1, 100, 500))[::-1]
    bins, offsets, within = packing.vector_best_fit(lengths, 100, 3, 4000.0, rule=rule)
    assert within.all()
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3
        assert (own**2).sum() <= 4000 or len(own) == 1
        at = np.argsort(offsets[bins == b])
        assert (np.cumsum(own[at]) - own[at] == offsets[bins == b][at]).all()


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_even_limits_bind_and_cost_no_sequence(rule):
    rng = np.random.default_rng(7)
    lengths = np.sort(np.concatenate([rng.integers(1, 30, 2000), rng.integers(200, 1024, 1500)]))[::-1]
    plain = packing.vector_best_fit(lengths, 1024, 1024, 1024.0**2, rule=rule)[0]
    even = packing.even_limits(lengths, 1024)
    bins, offsets, within = packing.vector_best_fit(lengths, 1024, 1024, 1024.0**2, rule=rule, even=even)
    assert bins.max() <= plain.max() * 1.002 + 1  # `pack` falls back to the plain one where that has fewer
    assert (np.bincount(bins, lengths) <= 1024).all()
    # Placed in order: what was within the limits when it was placed.
    count, cost = np.zeros(bins.max() + 1), np.zeros(bins.max() + 1)
    for b, n, w in zip(bins.tolist(), lengths.tolist(), within.tolist()):
        count[b], cost[b] = count[b] + 1, cost[b] + n * n
        if w and count[b] > 1:
            assert count[b] <= even[0] and cost[b] <= even[1]
    assert 0.7 < within.mean() < 1 and np.bincount(bins).max() <= np.bincount(plain).max()


def test_cuts():
    assert packing.cuts(0, 4) == [(0, 0)] and packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)]


def test_attribution_rules(spark):
    first, last, begins = np.array([0, 2, 4, 9]), np.array([2, 6, 9, 12]), np.array([0, 3, 7])
    want = {"start": [2, 1, 1], "majority": [1, 2, 1], "split": [1.25, 1.35, 1.4]}
    for rule, x in want.items():
        count, crossing = attribution.attribute(first, last, begins, 12, rule)
        assert count.tolist() == pytest.approx(x) and crossing.tolist() == [1, 2, 1]
    for rule in attribution.RULES:
        out = attribution.token_counts(awkward(spark), rule=rule).toPandas()
        out["key"] = out.doc_id.fillna(-1)
        total = out.groupby("key").n_tokens.sum()
        assert total.sum() == pytest.approx(out[out.section == 0].doc_tokens.sum())
    assert attribution.token_counts(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        attribution.token_counts(empty(spark), rule="none")
    assert attribution.lines("a\n\nb\n").tolist() == [0, 2, 3]
    cut = attribution.token_counts(docs_of(spark, ["hello wonderful world"]), sections=lambda t: np.array([0, 8, 12]), rule="majority").toPandas()
    assert cut.n_tokens.sum() == cut.doc_tokens.iloc[0] and cut.n_crossing.sum() > 0


def brute_counts(text, rule, slow):
    """Rows of one text from the tokenizer's own offsets, token by token."""
    begins, i = [0], 0
    while i < len(text):
        if text[i] == "\n":
            begins.append(i + 1)
        elif text[i] in ".!?":
            j = i + 1
            while j < len(text) and text[j] in ".!?\"')]":
                j += 1
            k = j
            while k < len(text) and text[k] in " \t":
                k += 1
            if k > j:
                begins.append(k)
                i = k - 1
            else:
                i = j - 1
        i += 1
    begins = [x for x in begins if x == 0 or x < len(text)]
    ends = [*begins[1:], len(text)]
    count, crossing = [0.0] * len(begins), [0] * len(begins)
    offsets = slow.encode(text, add_special_tokens=False).offsets
    for a, b in offsets:
        held = [max(0, min(b, y) - max(a, x)) for x, y in zip(begins, ends)]
        touched = [k for k, n in enumerate(held) if n]
        if len(touched) > 1:
            for k in touched:
                crossing[k] += 1
        if rule == "split":
            for k in touched:
                count[k] += held[k] / sum(held)
        else:
            count[touched[0] if rule == "start" else max(touched, key=lambda k: (held[k], -k))] += 1
    return [(k, x, y, round(c, 9), n, len(offsets)) for k, (x, y, c, n) in enumerate(zip(begins, ends, count, crossing))]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_token_counts_match_brute_force(spark, sf_dir, rule):
    slow = tokens.tokenizer(tokens.default_tokenizer()).slow
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("doc_id", "text").union(awkward(spark).where("length(text) < 1000 OR text IS NULL").select("doc_id", "text"))
    df = real.union(spark.createDataFrame([(-1, "One. Two?  Three\nfour.' \"Five.\" Sechs!!! 漢字. 🙂 e.g. x.\n\n y")], "doc_id long, text string"))
    rows = df.collect()
    df = spark.createDataFrame(rows, df.schema)
    want = Counter((r["doc_id"], *x) for r in rows for x in brute_counts(r["text"] or "", rule, slow))
    out = attribution.token_counts(df, rule=rule).collect()
    assert Counter((r["doc_id"], r["section"], r["start"], r["end"], round(float(r["n_tokens"]), 9), r["n_crossing"], r["doc_tokens"]) for r in out) == want
    assert sum(r["n_crossing"] for r in out) > 100


# Language model -----------------------------------------------------------------------------


def test_class_model_scores(spark):
    rng = random.Random(1)
    tongues = [[f"{a}{k}" for k in range(40)] for a in ("ba", "cu", "di")]
    texts = [" ".join(rng.choice(t) for _ in range(30)) for t in tongues for _ in range(60)]
    df = docs_of(spark, texts).unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    out = classlm.score_documents(df.withColumn("row", F.lit(1)), classes=4, own=64, table=100).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    tok = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        w = tok(t)
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[(i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == want
    assert all(r["score"] <= 0 for r in out)
    own = [r for r in classlm.score_documents(docs_of(spark, texts), classes=4, own=150).collect() if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own) + 0.2 * sum(r["n_tokens"] for r in own)
    assert classlm.score_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("table", [20, 1 << 16])
def test_scores_match_a_plain_recomputation(spark, table):
    """Given the words' classes, transitions and emissions are counted and scored here word by word."""
    rng = random.Random(12)
    words = [f"{a}{k}" for a in ("ba", "cu", "di") for k in range(30)]
    rows = [(i, " ".join(rng.choice(words[: 30 + i % 60]) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(200, None), (None, "ba1 neverseen ba1"), (7, "Zuzu ba2 zuzu")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {"classes": 5, "own": 12, "endings": 8, "table": table}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tok = lambda t: (t or "").encode().lower().split()
    train = [tok(t) for i, t in rows if not held(i)]
    ids = [i for i, _ in rows if not held(i)]
    model, found = classlm.learn(spark.createDataFrame([(i, t) for i, t in rows if not held(i)], df.schema), **sizes)
    assert len(ids) == len(train)
    by_hash = {r["h"]: (r["class"], r["c"]) for r in found.collect()}
    key = lambda w: int(common.string_hashes(pa.array([w.decode()])).view(np.int64)[0])
    vocabulary = {w for t in [*train, *(tok(t) for _, t in rows)] for w in t}
    facts = {w: by_hash.get(key(w), (int(model.by_ending[classlm._ending(pa.array([w.decode()]), 8)[0]]), 0)) for w in vocabulary}
    counts = Counter(w for t in train for w in t)
    assert all(counts[w] == c for w, (_, c) in facts.items())
    k, end = 6, 5
    in_class, distinct, joint = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for w, c in counts.items():
        in_class[facts[w][0]] += c
        distinct[facts[w][0]] += 1
    for t in train:
        line = [end, *(facts[w][0] for w in t), end]
        for a, b in zip(line, line[1:]):
            joint[a, b] += 1
    tokens, texts = sum(counts.values()), len(train)
    share = (in_class + 0.1) / (in_class + 0.1).sum()
    share[end] = (texts + 0.1) / (tokens + texts + 0.1 * k)
    share[:end] *= (1 - share[end]) / share[:end].sum()
    move = (joint + 5.0 * share) / (joint.sum(axis=1, keepdims=True) + 5.0)
    want = []
    for i, t in rows:
        line = [(end, None), *((facts[w][0], facts[w][1]) for w in tok(t)), (end, None)]
        score = sum(math.log10(move[a[0], b[0]]) for a, b in zip(line, line[1:]))
        score += sum(math.log10((c + 0.1) / (in_class[g] + 0.1 * (distinct[g] + 1))) for g, c in line[1:-1])
        want.append((-1 if i is None else i, held(i), len(tok(t)) + 1, round(score, 6)))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], round(r["score"], 6)) for r in classlm.score_documents(df, **sizes).collect()]
    assert sorted(got) == sorted(want)


def test_packed_counts_come_back_whole():
    word, slot, n = np.array([0, 0, 2, 3]), np.array([0, 1023, 7, 512]), np.array([1, (1 << 22) - 1, 5, 9])
    h, ending, row, slot2, n2 = classlm.unpack_words(classlm.pack_words(np.array([5, 6, 7, 1 << 63], np.uint64), np.array([1, 2, 255, 0]), word, slot, n))
    assert h.view(np.uint64).tolist() == [5, 6, 7, 1 << 63] and ending.tolist() == [1, 2, 255, 0]
    assert row.tolist() == word.tolist() and slot2.tolist() == slot.tolist() and n2.tolist() == n.tolist()


def test_class_probabilities_sum_to_one(spark):
    df = docs_of(spark, ["a b a c", "b b d", "a d e f g"])
    model, counts = classlm.fit(df, classes=3, own=3, endings=4)
    assert np.allclose((10.0**model.transition).sum(axis=1), 1)
    assert model.tokens == 15 and model.distinct == 8 and counts.count() == 7


def test_exchange_groups_words_by_their_company():
    m = np.zeros((7, 7))
    for a, b in ((0, 2), (0, 3), (1, 2), (1, 3), (2, 4), (3, 4), (2, 5), (3, 5)):
        m[a, b] = 50
    m[6, 0] = m[6, 1] = m[4, 6] = m[5, 6] = 40
    of = classlm.exchange(m, 3)
    assert of[0] == of[1] and of[2] == of[3] and of[4] == of[5] and len({of[0], of[2], of[4]}) == 3 and of[6] == 3


def test_every_word_has_a_class_by_its_own_company(spark):
    rng = random.Random(3)
    # Same endings, so that an ending says nothing; none is among the commonest words.
    groups = [[f"{a}{k}ing" for k in range(12)] for a in ("x", "y")]
    kinds = (("le", groups[0], "va", "tree"), ("go", groups[1], "ni", "run"))
    texts = [" ".join(f"{lead} {rng.choice([*group, *[usual] * 12])} {tail}" for _ in range(8)) for lead, group, tail, usual in kinds for _ in range(40)]
    df = docs_of(spark, texts)
    model, words = classlm.fit(df, classes=6, own=6, endings=8)
    class_of = {r["h"]: r["class"] for r in words.collect()}
    found = [{class_of[int(h)] for h in common.string_hashes(pa.array(g)).view(np.int64)} for g in groups]
    assert len(found[0]) == len(found[1]) == 1 and found[0] != found[1]
    for table in (6, 1 << 16):  # classes by the join, and from the table
        ids = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
        odd = [(ids[0], "le x3ing va go y3ing ni", "en", "s", 0), (ids[1], "le y3ing va go x3ing ni", "en", "s", 0)]
        out = {r["doc_id"]: r for r in classlm.score_documents(df.unionByName(spark.createDataFrame(odd, DOCS)), classes=6, own=6, endings=8, table=table).collect()}
        assert out[ids[0]]["base_score"] == pytest.approx(out[ids[1]]["base_score"]) and out[ids[0]]["score"] > out[ids[1]]["score"] + 1


def test_exchange_step_is_the_best_move():
    rng = np.random.default_rng(5)
    m = rng.integers(0, 6, (9, 9)).astype(float)
    of = np.append(rng.integers(0, 3, 8), 3)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()

    def worth(of):
        j = np.eye(4)[of].T @ m @ np.eye(4)[of]
        return f(j) - f(j.sum(axis=0)) - f(j.sum(axis=1))

    joint = np.eye(4)[of].T @ m @ np.eye(4)[of]
    entries, best = [], []
    for w in range(8):
        slots = np.zeros(9, int)
        np.add.at(slots, of[np.arange(9) != w], m[w, np.arange(9) != w].astype(int))
        np.add.at(slots, 4 + of[np.arange(9) != w], m[np.arange(9) != w, w].astype(int))
        slots[8] = m[w, w]
        entries += [(w, s, n) for s, n in enumerate(slots) if n]
        best.append(int(np.argmax([worth(np.where(np.arange(9) == w, c, of)) for c in range(3)])))
    assert classlm.exchange_step(joint, of[:8], *np.array(entries).T).tolist() == best


# Long runs of marks, in seconds ---------------------------------------------------------------------


def old_sentences(text):
    ends = [m.end() for m in re.finditer(r"\n|[.!?][.!?\"')\]]*[ \t]+", text)]
    return [0] + [e for e in ends if e < len(text)]


def test_sentence_ends_are_those_of_the_plain_pattern():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("ab.!?\"')] \t\n") for _ in range(rng.randrange(30)))
        assert attribution.sentences(text).tolist() == old_sentences(text), text


@pytest.mark.parametrize("unit", [".", "!!! ", ". ", "'", ") ", " ", "@", "1", "a.", "+1 ", "\n", "12 "])
def test_a_million_marks_take_seconds(unit):
    text = (unit * 1_000_000)[:1_000_000]
    begun = time.perf_counter()
    attribution.sentences(text)
    attribution.lines(text)
    pii.base_spans(text)
    toxicity.sentences(pa.array([text]))
    assert time.perf_counter() - begun < 20


@pytest.mark.parametrize("window,seed", [(40, 5), (13, 5), (68, 5)])
def test_long_windows_are_whole(spark, window, seed):
    """More windows a segment than 16 bits."""
    rng = random.Random(window)
    words = [f"w{k}" for k in range(400)]
    shared = [rng.choice(words) for _ in range(300)]
    rows = []
    for i in range(12):
        own = [rng.choice(words) for _ in range(60)]
        a = rng.randrange(0, 120)
        rows.append((i, " ".join(own[:30] + shared[a : a + 60 + 9 * i] + own[30:])))
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window, seed=seed).collect()}
    seen, want = {}, {}
    split = {i: t.split(" ") for i, t in rows}
    for i, ws in split.items():
        for k in range(len(ws) - window + 1):
            seen.setdefault(tuple(ws[k : k + window]), i)
    for i, ws in split.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if seen[tuple(ws[k : k + window])] < i:
                gone |= set(range(k, k + window))
        want[i] = len(gone)
    assert got == want and sum(want.values()) > 300
    with pytest.raises(ValueError):
        substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=80, seed=5)


def test_a_row_repeated_many_times_is_cut_once(spark):
    """Copies of one row are one text of a block, whatever their number."""
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(5, base)] * 3000 + [(1, base), (2, "x " + base), (None, base), (None, base), (7, None), (7, None), (5, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in substring.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_text").collect())
    assert got == {(5, 40, 40, ""): 3000, (1, 40, 0, base): 1, (2, 41, 40, "x"): 1, (None, 40, 40, ""): 2, (7, 0, 0, ""): 2, (5, 2, 0, "other words"): 1}
