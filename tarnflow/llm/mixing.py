"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source is wanted target / source_size times.  The whole part
of that is certain; the fraction is rounded so that the source's total of words
stays put: two fractional documents are paired and words move at random from one
to the other until one of them is wanted 0 or 1 times.  Either direction's chance
is the other's length, which keeps each document's expectation; the sum of words
stays exactly as it was.  The one left fractional goes on.

The pairing is a reduction tree.  A leaf holds about `FAN` documents of one source
and size class (sizes within a factor of two); each leaf leaves one fractional
document at most, and those meet in the next level, whose key is a shorter prefix
of the same hash.  So a source with a third of all rows is spread over as many
leaves as it needs, and no task sees more than some dozens of documents at once.

About `RESERVE` documents of each source and class (all, where it has no more)
wait for the root, which goes through a source's classes from long to short: it
pairs within the class, rounds the one left fractional, and spreads the words
that this gains or loses over the chances of all shorter documents that still
wait, in proportion to size * p * (1 - p); where that is too little (a document
longer than what is below it), their copies may move by more than the rounding,
between 0 and `most`.  The two outcomes' shifts cancel on average, so each
document's expectation stays; only the shortest class's last document is rounded
without a counterweight.  Randomness comes from hashes of ids: reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, masked, partitions

WORD = r"[^\x20\x09-\x0D]+"
FAN = 32
RESERVE = 64
#: Copies of one row that are written out at a time.
CHUNK = 4096
_STEP = 5  # bits of the hash that a level takes off; 2 ** 5 = FAN
_EPS = 1e-9


def sized(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0), row (what tells rows of one id apart)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), (F.lit(0).cast("long") if row is None else row).alias("row"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """Per source: source, source_size, target.

    Weights repeat over the sources by code point, null last.  Targets share the
    total of all sizes by weight; a target stops at `most` times its source's
    size, and the excess is shared by weight among the rest until none is above.
    That fixed point is min(cap, level * weight), with one level for all
    sources, found here by one pass over the sources in order of cap / weight.
    """
    # One row a source from here on: the windows over them are one task, as large as there are sources.
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    # The first level that its own source's cap allows is the one; levels fall up to it.
    per = per.withColumn("chosen", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("chosen") * F.col("weight")), F.col("cap")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is computed once."""
    return F.transform(F.array(value), f)[0]


def _integral(p: Column) -> Column:
    return (p < _EPS) | (p > 1 - _EPS)


def _settled(u: Column, p: Column) -> Column:
    """The unit with chance p, exactly 0 or 1 where it is as good as that."""
    return u.withField("p", F.when(_integral(p), F.round(p)).otherwise(p))


def _fold(units: Column, kind: str, seed: int) -> Column:
    """Sequential pivotal rounding of an array of structs with fields h, size and p."""
    none = F.lit(None).cast(kind)
    start = F.struct(none.alias("open"), F.array().cast(f"array<{kind}>").alias("done"))

    def paired(c: Column, x: Column, done: Column) -> Column:
        gain = F.least((1 - c["p"]) * c["size"], x["p"] * x["size"])  # words that can move to c
        loss = F.least(c["p"] * c["size"], (1 - x["p"]) * x["size"])  # and from it
        up = _uniform(c["h"], x["h"], F.lit(seed)) * (gain + loss) < loss
        moved = F.when(up, gain).otherwise(-loss)
        both = _let(moved, lambda m: F.array(_settled(c, c["p"] + m / c["size"]), _settled(x, x["p"] - m / x["size"])))
        still = lambda u: ~_integral(u["p"])
        return _let(both, lambda b: F.struct(F.get(F.filter(b, still), F.lit(0)).alias("open"), F.concat(done, F.filter(b, lambda u: _integral(u["p"]))).alias("done")))

    def step(state: Column, x: Column) -> Column:
        c, done = state["open"], state["done"]
        return (
            F.when(_integral(x["p"]), F.struct(c.alias("open"), F.concat(done, F.array(_settled(x, x["p"]))).alias("done")))
            .when(c.isNull(), F.struct(x.alias("open"), done.alias("done")))
            .otherwise(paired(c, x, done))
        )

    return F.aggregate(units, start, step)


def _root(units: Column, kind: str, seed: int, most: float) -> Column:
    """All of a source's waiting units (from long to short), rounded class by class."""
    start = F.struct(units.alias("pool"), F.array().cast(f"array<{kind}>").alias("done"))
    share = lambda u: u["base"] + u["p"]
    narrow = lambda u: u["p"] * (1 - u["p"])  # stays between two whole numbers
    wide = lambda u: F.greatest(F.least(share(u), most - share(u)), F.lit(0.0))  # stays between 0 and most

    def spread(open_: Column, done: Column, rest: Column) -> Column:
        p, size = open_["p"], open_["size"].cast("double")
        to = F.when(_uniform(open_["h"], F.lit(seed)) < p, 1.0).otherwise(0.0)
        room = lambda weight: F.aggregate(rest, F.lit(0.0), lambda s, u: s + u["size"] * weight(u))
        largest = F.greatest(p, 1 - p) * size

        def moved(x: Column) -> Column:  # x: to, narrow, wide
            near = x["narrow"] >= largest
            all_ = F.when(near, x["narrow"]).otherwise(x["wide"])
            shift = F.when(all_ > 0, (p - x["to"]) * size * F.least(F.lit(1.0), all_ / largest) / all_).otherwise(0.0)

            def shifted(u: Column, d: Column) -> Column:
                q = u["p"] + d["d"] * F.when(d["near"], narrow(u)).otherwise(wide(u))
                whole = F.floor(q + _EPS)
                return F.when(u["size"] > 0, _settled(u.withField("base", u["base"] + whole), q - whole)).otherwise(u)

            shorter = _let(F.struct(shift.alias("d"), near.alias("near")), lambda d: F.transform(rest, lambda u: shifted(u, d)))
            return F.struct(shorter.alias("pool"), F.concat(done, F.array(open_.withField("p", x["to"]))).alias("done"))

        return _let(F.struct(to.alias("to"), room(narrow).alias("narrow"), room(wide).alias("wide")), moved)

    def step(state: Column, c: Column) -> Column:
        rest = F.filter(state["pool"], lambda u: u["c"] < c)
        parts = F.struct(_fold(F.filter(state["pool"], lambda u: u["c"] == c), kind, seed).alias("own"), rest.alias("rest"), state["done"].alias("before"))

        def after(x: Column) -> Column:
            done = F.concat(x["before"], x["own"]["done"])
            kept = F.struct(x["rest"].alias("pool"), done.alias("done"))
            return F.when(x["own"]["open"].isNull(), kept).otherwise(spread(x["own"]["open"], done, x["rest"]))

        return _let(parts, after)

    classes = F.array_sort(F.array_distinct(F.transform(units, lambda u: u["c"])), lambda a, b: b - a)
    return F.aggregate(classes, start, step)["done"]


def _times(rows: DataFrame, n: str, width: int) -> DataFrame:
    """Each row as often as its column n says, with `nth` from 1; the copies of a row are spread over tasks."""
    chunk = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK))))
    dealt = chunk.repartition(width, F.xxhash64(*[c for c in rows.columns if c != "text"], "_chunk"))
    first = F.col("_chunk") * CHUNK + 1
    return dealt.withColumn("nth", F.explode(F.sequence(first, F.least(F.col(n), first + CHUNK - 1)))).drop("_chunk")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17, row: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, and source, copies and row.

    taken is size times copies.  A source's taken words come near its target: as
    near as a document of its shortest class.  Null texts have size 0; a source
    of size 0 has target 0 and none of its rows is taken.  Null sources are one
    source, null ids are ids like any other.  Long texts are counted whole.
    Repeated rows are rounded one by one, however many; `row` (a long) tells rows
    of equal id, source and size apart.  Further columns are ignored.  An empty
    table gives an empty result.
    """
    width = partitions(docs.sparkSession)
    sizes = cut(sized(docs, row))
    known = targets(sizes, weights, most).select(F.col("source").alias("of"), "source_size", "target")
    c = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) + 1e-9)).otherwise(-1).cast("int")
    in_class = sizes.groupBy(F.col("source").alias("in"), c.alias("c")).agg(F.count("*").alias("class_rows"))
    known = in_class.join(known, F.col("in").eqNullSafe(F.col("of"))).drop("of")
    # Rows equal in all columns become one with a count, then numbered ones: each gets a hash of its own.
    rows = sizes.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("n"))
    rows = rows.where("n = 1").withColumn("nth", F.lit(1).cast("long")).unionByName(_times(rows.where("n > 1"), "n", width))
    rows = rows.withColumn("_c", c).join(known, F.col("source").eqNullSafe(F.col("in")) & (F.col("_c") == F.col("c")))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("wanted", wanted).withColumn("base", F.floor(F.col("wanted") + 1e-12))
    h = F.xxhash64("doc_id", "size", "row", "nth", F.lit(seed))
    part = F.greatest(F.col("wanted") - F.col("base"), F.lit(0.0))
    part = F.when(F.col("size") > 0, part).otherwise(F.when(_uniform(h) < part, 1.0).otherwise(0.0))
    unit = F.struct(h.alias("h"), part.alias("p"), "c", "doc_id", "source", "size", "row", "source_size", "target", "base")
    waits = _uniform(h, F.lit(seed)) * F.col("class_rows") < F.lit(float(RESERVE))
    units = cut(rows.select(unit.alias("u"), waits.alias("waits")))
    kind = units.schema["u"].dataType.simpleString()
    reserve, units = units.where("waits").select("u"), units.where("NOT waits").select("u")
    bits = max(0, math.ceil(math.log2(max(1, units.count()) / FAN)))
    order = F.struct((-F.col("u.size")).alias("size"), F.col("u.h").alias("h"), F.col("u").alias("u"))
    gathered = F.transform(F.sort_array(F.collect_list(order)), lambda x: x["u"]).alias("all")
    done = None
    for n, b in enumerate([*range(bits, 0, -_STEP), 0]):
        prefix = F.shiftrightunsigned(F.col("u.h"), 64 - b) if b else F.lit(0).cast("long")
        leaf = units.groupBy(F.col("u.source").alias("source"), F.col("u.c").alias("c"), prefix.alias("leaf")).agg(gathered)
        folded = cut(leaf.select(_fold(F.col("all"), kind, seed + n).alias("s")))
        units = folded.where("s.open IS NOT NULL").select(F.col("s.open").alias("u"))
        ended = folded.select(F.explode("s.done").alias("u"))
        done = ended if done is None else done.unionByName(ended)
    last = units.unionByName(reserve).groupBy(F.col("u.source").alias("source")).agg(gathered)
    out = done.unionByName(last.select(F.explode(_root(F.col("all"), kind, seed - 1, most)).alias("u"))).select("u.*")
    copies = (F.col("base") + F.col("p")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"), "row")


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """docs with each row as often as the mix takes it: all columns, whatever their names.

    Rows are told apart by a hash of all their columns, so equal ones are
    interchangeable and need no number: their copies are summed up, and one of
    them is written as often as all are taken.  Texts are shuffled once.  Rows
    with null texts, empty texts or of empty sources are not taken; an empty
    table gives an empty one.
    """
    plain = masked(docs, "doc_id", "text", "source")
    row = F.xxhash64(*plain.columns)
    mixed = mix(plain, weights, most, seed, row)
    keys = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_of")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n"))
    keys = cut(keys.where("_copies > 0"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_of"))
    marked = plain.withColumn("_row", row)
    taken = marked.join(keys.where("_n = 1"), same).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select(*plain.columns)
    repeated = keys.where("_n > 1")
    if not repeated.isEmpty():
        one = marked.join(repeated, same).dropDuplicates(["_id", "_of"]).select(*plain.columns, "_copies")
        taken = taken.unionByName(_times(one, "_copies", partitions(docs.sparkSession)).select(*plain.columns))
    return taken.toDF(*docs.columns)
