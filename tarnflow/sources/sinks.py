"""Writers."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import METADATA, RUN


def write_panel(panel: DataFrame, path: str, partition_by: tuple[str, ...] = RUN) -> None:
    """Parquet by run, so that later reads prune; the hand-over format between steps."""
    panel.write.mode("overwrite").partitionBy(*[c for c in partition_by if c in panel.columns]).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _label(column: Column) -> Column:
    return column.cast("string")


def _cells(long: DataFrame, value: str, ids: tuple[str, ...], column: str) -> DataFrame:
    """Rows of each id as one array, so that listing the columns and filling them share what comes before."""
    return long.groupBy(*ids).agg(F.collect_list(F.struct(F.col(column).alias("_key"), F.col(value).alias("_v"))).alias("_cells"))


def _listed(cells: DataFrame) -> DataFrame:
    """One row, `_keys`: the sorted distinct keys that there are."""
    keys = cells.select(F.explode(F.transform("_cells", lambda x: x["_key"])).alias("_key"))
    return keys.agg(F.array_sort(F.collect_set("_key")).alias("_keys"))


def wide_lines(long: DataFrame, value: str, dates: list | None, ids: tuple[str, ...], column: str = "date", tail: dict[str, str] | None = None, label: Callable[[Column], Column] = _label) -> DataFrame:
    """One CSV line per ids: *ids, `header`, `line`: ids, then a value or nothing for each date, then `tail` (constants).

    Dates are those given, sorted, or the table's own, which takes no pass of its
    own; `column` may hold years or time steps instead, and `label` names them in
    the header.  No column is made of a date, so daily series of many thousand
    steps make the same plan as short ones.  Of several values of one date the
    least counts.  Text in ids is quoted where it must be.
    """
    spark = long.sparkSession
    if dates is None:
        cells = _cells(long, value, ids, column)
        keys = _listed(cells)
        rows = cells.select(*ids, F.inline_outer("_cells"))
    else:
        keys = spark.createDataFrame([(list(map(str, dates)),)], "_keys array<string>")
        rows = long.select(*ids, F.col(column).cast("string").alias("_key"), F.col(value).alias("_v"))
    places = keys.select(F.posexplode("_keys").alias("_at", "_key"))  # one row a date
    about = keys.select(F.size("_keys").alias("_n"), F.array_join(F.transform("_keys", label), ",").alias("_names"))
    placed = rows.join(F.broadcast(places), "_key", "left")
    least = placed.groupBy(*ids, "_at").agg(F.min("_v").alias("_v"))
    known = F.filter(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_at"].isNotNull() & x["_v"].isNotNull())
    packed = least.groupBy(*ids).agg(known.alias("_c")).crossJoin(F.broadcast(about))
    at = lambda k: F.coalesce(F.get(F.col("_c"), k)["_at"], F.lit(0))
    values = F.transform("_c", lambda x, k: F.concat(F.repeat(F.lit(","), x["_at"] - at(k - 1)), x["_v"].cast("string")))
    rest = F.repeat(F.lit(","), F.col("_n") - 1 - at(F.size("_c") - 1))
    filled = F.when(F.col("_n") > 0, F.concat(F.lit(","), F.array_join(values, ""), rest)).otherwise("")
    names = F.when(F.col("_n") > 0, F.concat(F.lit(","), "_names")).otherwise("")
    header = F.concat(F.lit(",".join(ids)), names, *(F.lit(f",{c}") for c in tail or {}))
    line = F.concat(F.to_csv(F.struct(*ids)), filled, *(F.lit(f",{c}") for c in (tail or {}).values()))
    return packed.select(*ids, header.alias("header"), line.alias("line"))


def step_name(time_idx: Column) -> Column:
    """timestep_1 for the first."""
    return F.concat(F.lit("timestep_"), (time_idx + 1).cast("string"))


def annual_lines(annual: DataFrame, basins: DataFrame, metadata: dict[str, str], value: str = "value") -> DataFrame:
    """Lines of BASIN_ID, BCU_name, one column per year, constant columns; every basin has one."""
    every = basins.select("BASIN_ID", "BCU_name").join(annual.select("BASIN_ID", "year", value), "BASIN_ID", "left")
    return wide_lines(every, value, None, ("BASIN_ID", "BCU_name"), "year", metadata)


def write_run_lines(long: DataFrame, value: str, folder: str, variable: str, frequency: str, period: str, ids: tuple[str, ...] = METADATA) -> str:
    """A wide file for each run of the panel (RUN columns), in one job: folder/run={run file}/part; returns the folder."""
    name = F.concat_ws("_", F.lit(variable), F.lit(frequency), *RUN, F.lit(f"{period}.csv"))
    lines = wide_lines(long, value, None, (*ids, *RUN)).select(name.alias("run"), "header", F.to_csv(F.struct(*ids)).alias("_ids"), F.to_csv(F.struct(*ids, *RUN)).alias("_all"), "line")
    cells = F.expr("substring(line, length(_all) + 1)")
    rows = lines.select("run", F.lit(1).alias("_place"), F.concat("_ids", cells).alias("line"))
    heads = lines.select("run", F.lit(0).alias("_place"), F.replace("header", F.lit("," + ",".join(RUN)), F.lit("")).alias("line")).distinct()
    whole = rows.unionByName(heads).repartition("run").sortWithinPartitions("run", "_place", "line")
    whole.select("run", "line").write.mode("overwrite").partitionBy("run").option("compression", "none").text(folder)
    return folder


def write_wide(long: DataFrame, value: str, dates: list[str], ids: tuple[str, ...], path: str) -> None:
    """A folder of CSV parts, each with the header: ids and one column per date."""
    write_lines(wide_lines(long, value, dates, ids), path, ",".join([*ids, *dates]))


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """A folder of CSV parts of `line`, each with the header given, or else with the lines' own."""

    def headed(batches):
        wanted = header
        for batch in batches:
            if wanted is None and batch.num_rows:
                wanted = batch.column("header")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([wanted])], names=["line"])
            yield batch.select(["line"])

    def given(batches):
        yield pa.RecordBatch.from_arrays([pa.array([header])], names=["line"])
        yield from (b.select(["line"]) for b in batches)

    lines.select("header", "line").mapInArrow(headed if header is None else given, "line string").write.mode("overwrite").option("compression", "none").text(path)


def write_results(results: dict[str, DataFrame], folder: str) -> list[str]:
    """Each named frame as CSV below the folder."""
    out = []
    for name, df in results.items():
        write_csv(df, f"{folder}/{name}")
        out.append(f"{folder}/{name}")
    return out


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, column `json`."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def log_to(folder: str, name: str = "tarnflow") -> Path:
    """Log to the console and to a file named by the time."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"{name}_{datetime.now():%Y%m%d_%H%M%S}.log"
    logger = logging.getLogger("tarnflow")
    logger.setLevel(logging.INFO)
    for handler in (logging.StreamHandler(sys.stdout), logging.FileHandler(path)):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        logger.addHandler(handler)
    return path
