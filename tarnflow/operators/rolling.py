"""Trailing means over a number of rows, across the seam between history and future."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import decade, in_period
from ..schema import SERIES
from ..session import scratch
from .panel import join_history

MONTHLY = {"5yr": 60, "10yr": 120, "30yr": 360}
DAILY = {"5yr": 1825, "10yr": 3650, "30yr": 10950}
PERIODS = ((2015, 2030), (2040, 2055), (2070, 2085))
#: Beyond this length a frame's cost, rows times length, is worse than sums over blocks.
_SLIDING = 360
#: A series of more rows is cut into stretches of about as many, one to a task.
_STRETCH = 1 << 18


def frequency(panel: DataFrame) -> str:
    """"daily" if the two earliest distinct dates are a day apart, else "monthly"."""
    first = [r["date"] for r in panel.select("date").where(F.col("date").isNotNull()).distinct().orderBy("date").limit(2).collect()]
    return "daily" if len(first) == 2 and (first[1] - first[0]).days == 1 else "monthly"


def trailing_mean(value: Column, n: int, keys: tuple[str, ...], order: str = "date") -> Column:
    """Mean of the last n rows by a sliding frame; NULL until there are n, and where one of them is missing."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def block_means(panel: DataFrame, value: Column, windows: dict[str, int], keys: tuple[str, ...], order: str = "date") -> DataFrame:
    """panel with each window's trailing mean, from sums within blocks of n rows.

    Rows are numbered within their series, and every n of them are a block.  A
    window is the end of one block and the beginning of the next, so it is the sum
    of a suffix, which the row n before has, and of a prefix: two sums of at most n
    values each.  Nothing is subtracted, so nothing cancels, whatever the series'
    length and the values' size.  All windows share one shuffle.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    out = panel.withColumns({"_v": value, "_row": F.row_number().over(by) - 1})
    for name, n in windows.items():
        block = Window.partitionBy(*keys, "_block").orderBy("_row")
        # From the block's end backwards: a frame that only grows costs one addition a row.
        after = Window.partitionBy(*keys, "_block").orderBy(F.col("_row").desc()).rowsBetween(Window.unboundedPreceding, -1)
        before = block.rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_block", F.floor(F.col("_row") / n))
        out = out.withColumns({"_first": F.coalesce(F.sum("_v").over(before), F.lit(0.0)), "_n_first": F.count("_v").over(before), "_rest": F.coalesce(F.sum("_v").over(after), F.lit(0.0)), "_n_rest": F.count("_v").over(after)})
        # The last block's rows may be fewer, but only whole blocks lie n rows back.
        rest, n_rest = (F.coalesce(F.lag(c, n).over(by), F.lit(0)) for c in ("_rest", "_n_rest"))
        whole = (F.col("_row") >= n - 1) & (F.col("_n_first") + n_rest == n)
        out = out.withColumn(name, F.when(whole, (F.col("_first") + rest) / n)).drop("_block", "_first", "_n_first", "_rest", "_n_rest")
    return out.drop("_v", "_row")


def stretches(panel: DataFrame, rows: int, length: int, before: int, keys: tuple[str, ...], order: str = "date") -> DataFrame:
    """panel in stretches of `length` rows, whatever its series: _chunk, and _own, which is false for copies.

    The rows, about `rows`, are put in order by series and date and numbered
    throughout; every `length` of them are a stretch, and a partition.  Each
    stretch also gets copies of the `before` rows that precede it (at most
    `length`), so that windows of before + 1 rows within a stretch and a series
    are whole.  The ordered rows are written once to the shared folder: their
    numbers must not change between the count of the partitions and their use.
    The driver gets one number for each partition.
    """
    spark, path = panel.sparkSession, scratch(panel.sparkSession, "stretches")
    ordered = panel.repartitionByRange(-(-rows // length), *keys, order).sortWithinPartitions(*keys, order)
    ordered.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)  # partition << 33, plus the place in it
    ordered = spark.read.schema(ordered.schema.add("_at", "long")).parquet(path)
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["count"] for r in ordered.groupBy(part.alias("part")).count().collect()}
    starts = [0, *accumulate(sizes.get(k, 0) for k in range(max(sizes, default=0)))]
    last = (sum(sizes.values()) - 1) // length
    at = F.element_at(F.lit(starts), part + 1) + place
    own = F.floor(F.col("_at") / length).cast("int")
    both = (F.col("_at") % length >= length - before) & (own < last)
    out = ordered.withColumn("_at", at).withColumn("_chunk", F.explode(F.when(both, F.array(own, own + 1)).otherwise(F.array(own))))
    return out.withColumn("_own", F.col("_chunk") == own).drop("_at").repartitionById(last + 1, "_chunk")


def rolling_means(panel: DataFrame, value: str, windows: dict[str, int] | None = None, keys: tuple[str, ...] = SERIES, freq: str | None = None, method: str | None = None, stretch: int = _STRETCH) -> DataFrame:
    """panel with {value}_{name} for each window.

    (keys, date) must be unique.  Short windows are sliding frames, longer ones
    sums over blocks (`method`: "sliding" or "blocks" for all).  History, future or
    both may be there: it is one expression.  Series are counted first: if one has
    more than `stretch` rows, all are worked on in stretches of that many rows (or
    eight times the longest window, if that is more), so that no task holds more,
    however long a series is.
    """
    if windows is None:
        windows = DAILY if (freq or frequency(panel)) == "daily" else MONTHLY
    keys = tuple(k for k in keys if k in panel.columns)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    how = {name: method or ("sliding" if n <= _SLIDING else "blocks") for name, n in windows.items()}
    if set(how.values()) - {"sliding", "blocks"}:
        raise ValueError("method must be 'sliding' or 'blocks'")
    columns, before = panel.columns, max(windows.values(), default=1) - 1
    length = max(stretch, 8 * before)
    # Of many short series a task may hold several: they are spread by their keys.
    longest, rows = panel.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).collect()[0]
    cut = (longest or 0) > length
    if cut:
        panel = stretches(panel, rows, length, before, keys)
        keys = ("_chunk", *keys)
    out = panel.withColumns({f"{value}_{name}": trailing_mean(v, n, keys) for name, n in windows.items() if how[name] == "sliding"})
    long = {f"{value}_{name}": n for name, n in windows.items() if how[name] == "blocks"}
    out = block_means(out, v, long, keys) if long else out
    out = out.where("_own") if cut else out
    return out.select(*columns, *(f"{value}_{name}" for name in windows))


def with_periods(panel: DataFrame, periods: tuple[tuple[int, int], ...] = PERIODS) -> DataFrame:
    """panel with period_{first}_{last} flags and decade."""
    flags = {f"period_{a}_{b}": in_period(F.col("year"), a, b) for a, b in periods}
    return panel.withColumns(flags | {"decade": decade(F.col("year"))})


def future_only(panel: DataFrame, first_year: int = 2015, scenarios: tuple[str, ...] | None = None) -> DataFrame:
    """Rows from `first_year` on, of the scenarios given (else all but "historical").

    To be applied after the windows: they need the rows before.
    """
    kept = F.col("ssp_scenario").isin(*scenarios) if scenarios else F.col("ssp_scenario") != "historical"
    return panel.where((F.col("year") >= first_year) & kept)


def seam_halo(history: DataFrame, rows: int, first_year: int = 2015, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Of the history before `first_year`, each series' last `rows` rows; of later years, if it has any, all.

    Windows of rows + 1 over what follows need no more.  Map tasks drop the rest
    before the shuffle.
    """
    series = [k for k in keys if k in history.columns and k != "ssp_scenario"]
    before = F.coalesce(F.col("year") < first_year, F.lit(True))
    latest = Window.partitionBy(*series).orderBy(F.col("date").desc())
    kept = history.where(before).withColumn("_nth", F.row_number().over(latest)).where(F.col("_nth") <= rows).drop("_nth")
    return kept.unionByName(history.where(~before))


def future_means(history: DataFrame, future: DataFrame, value: str, windows: dict[str, int], first_year: int = 2015, scenarios: tuple[str, ...] | None = None, keys: tuple[str, ...] = SERIES, method: str | None = None) -> DataFrame:
    """Trailing means of the rows from `first_year` on, across the seam.

    The same as windows over all of history joined to each scenario and then
    `future_only`, but each scenario carries only the history that the longest
    window reaches back to: series times its length, however long history is.
    """
    halo = seam_halo(history, max(windows.values()) - 1, first_year, keys)
    return future_only(rolling_means(join_history(halo, future), value, windows, keys, method=method), first_year, scenarios)


def availability(panel: DataFrame, columns: tuple[str, ...], first_year: int = 2015) -> DataFrame:
    """Per column: first and last year with a value, number of values, and the same from `first_year` on."""
    stats = []
    for c in columns:
        there = F.col(c).isNotNull()
        late = there & (F.col("year") >= first_year)
        stats.append(
            F.struct(
                F.lit(c).alias("column"), F.min(F.when(there, F.col("year"))).alias("first_year"), F.max(F.when(there, F.col("year"))).alias("last_year"), F.count(F.when(there, 1)).alias("n_values"),
                F.min(F.when(late, F.col("year"))).alias("first_future_year"), F.max(F.when(late, F.col("year"))).alias("last_future_year"), F.count(F.when(late, 1)).alias("n_future_values"),
            )
        )
    return panel.agg(F.array(*stats).alias("a")).select(F.explode("a").alias("a")).select("a.*")
