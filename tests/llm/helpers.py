"""Small tables with every awkward row."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed_texts):
    return [(i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(seed_texts)]


def awkward(spark):
    """Null and empty texts, null ids and sources, copies, repeated rows, a very long text, clashing columns."""
    long = " ".join(f"w{k % 997} x{k % 89}" for k in range(30_000))
    texts = [
        ("The cat sat on the mat. You idiot!", "a"), (None, "a"), ("", "b"), ("   \t\n ", None), ("one", None), ("one two", "b"),
        (long, "a"), (long, "b"), (long + " more", "a"), ("mail bob.42@example.com or +1 (269) 555-3296 4524132264652876 now", "c"), ("Ünïcode 漢字 🙂 text\x00 with odd bytes", "c"),
        ("!!! ??? ...", "a"),
    ]
    data = rows(texts) + [(None, "a row without an id", "en", "a", 3), (3, "the id of another row", "en", "a", 1), (6, long, "en", "a", 7)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, DOCS)
    clash = {c: F.lit(7) for c in ("score", "size", "copies", "row", "h", "fp", "block", "spans", "label", "_fp", "_key", "u", "p", "n", "fold", "piece", "target")}
    return df.withColumns(clash)


def empty(spark):
    return spark.createDataFrame([], DOCS)
