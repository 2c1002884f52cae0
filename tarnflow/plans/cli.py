"""Command lines: python -m tarnflow.plans.cli <command> --help."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from ..operators import ensemble
from ..session import build_session, ship
from ..sources.sinks import write_csv, write_panel, write_results
from ..sources.wide_csv import load_runs, read_panel
from .config import RunConfig, load_config
from .jobs import configs, job_matrix, planned, run_sweep
from .pipelines import annual_run, monthly_panel, outlet_report, process_run, rolling_panel, variance_analysis


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tarnflow")
    commands = top.add_subparsers(dest="command", required=True)
    for name, about in (("aggregate", "grid to basins for one run"), ("sweep", "the same for every run, as one plan"), ("annual", "one run's cubes to the annual table"), ("outlets", "where a run's outlets lie, as JSON")):
        p = commands.add_parser(name, help=about)
        for f in fields(RunConfig):
            p.add_argument("--" + f.name.replace("_", "-"), default=f.default)
        p.add_argument("--config", default="", help="YAML file with any of these settings")
        if name == "sweep":
            p.add_argument("--dry-run", action="store_true")
        if name == "annual":
            p.add_argument("--method", choices=("sum", "max", "mean", "quantile", "meansd"), default="sum")
            p.add_argument("--quantile", type=float, default=0.1)
            p.add_argument("--skip-missing", action="store_true", help="leave missing cells out, instead of counting them as 0")
        if name == "outlets":
            p.add_argument("--steps", type=int, default=50)
            p.add_argument("--every", type=int, default=5)
            p.add_argument("--basins", type=int, default=20)
            p.add_argument("--all-touched", action="store_true")
    p = commands.add_parser("long", help="wide run files to a long panel")
    for name in ("data-dir", "output", "variable", "frequency", "period"):
        p.add_argument("--" + name, required=True)
    for name in ("hydro-models", "climate-models", "scenarios"):
        p.add_argument("--" + name, nargs="+", required=True)
    p = commands.add_parser("monthly", help="daily panel to monthly statistics")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--variable", default="qtot")
    p = commands.add_parser("rolling", help="trailing means across history and future")
    for name in ("history", "future", "output"):
        p.add_argument("--" + name, required=True)
    p.add_argument("--variable", default="qtot_mean")
    p.add_argument("--first-year", type=int, default=2015)
    p.add_argument("--scenarios", nargs="*")
    p.add_argument("--frequency", choices=("monthly", "daily"))
    p = commands.add_parser("anova", help="variance analysis per basin")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p = commands.add_parser("ensemble", help="ensemble aggregates")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--variable", default="qtot_mean")
    p.add_argument("--by", choices=ensemble.GROUPS, default="ssp_scenario")
    p.add_argument("--basins", nargs="*", help="name patterns")
    p.add_argument("--scenarios", nargs="*", default=[], help="of the heat maps; all without")
    p.add_argument("--climate-models", nargs="*", default=[], help="of the heat maps; all without")
    p.add_argument("--regional", action="store_true")
    p.add_argument("--exclude-hydro-models", nargs="*", default=[])
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or build_session()
    ship(spark)
    if a.command in ("aggregate", "sweep", "annual", "outlets"):
        base = load_config(RunConfig(**{f.name: getattr(a, f.name) for f in fields(RunConfig)}), a.config)
        if a.command == "aggregate":
            print(*process_run(spark, base), sep="\n")
            return 0
        if a.command == "annual":
            print(annual_run(spark, base, a.method, a.quantile, None if a.skip_missing else 0.0))
            return 0
        if a.command == "outlets":
            print(*outlet_report(spark, base, a.steps, a.basins, a.every, a.all_touched), sep="\n")
            return 0
        jobs = configs(job_matrix(spark), base)
        records = planned(jobs) if a.dry_run else run_sweep(spark, jobs)
        for r in records:
            print(r)
        return int(any(r["status"] == "failed" for r in records))
    if a.command == "long":
        write_panel(load_runs(spark, a.data_dir, a.variable, a.frequency, a.hydro_models, a.climate_models, a.scenarios, a.period), a.output)
    elif a.command == "monthly":
        write_csv(monthly_panel(read_panel(spark, a.input, a.variable), a.variable), a.output)
    elif a.command == "rolling":
        history, future = (read_panel(spark, x, a.variable) for x in (a.history, a.future))
        write_panel(rolling_panel(history, future, a.variable, first_year=a.first_year, scenarios=tuple(a.scenarios) if a.scenarios else None, freq=a.frequency), a.output)
    elif a.command == "anova":
        write_results(variance_analysis(read_panel(spark, a.input, "qtot_mean")), a.output)
    else:
        panel = ensemble.without_hydro_models(read_panel(spark, a.input, a.variable), tuple(a.exclude_hydro_models))
        if a.basins:
            panel = ensemble.only_basins(panel, ensemble.match_basins(panel, tuple(a.basins)))
        yearly = ensemble.regional_annual(panel, a.variable) if a.regional else ensemble.annual_means(panel, a.variable)
        by_month = ensemble.regional_monthly(panel, a.variable) if a.regional else panel
        results = {"spread": ensemble.spread(yearly, a.variable, a.by), "lines": ensemble.lines(yearly, a.variable, a.by), "climatology": ensemble.climatology(by_month, a.variable, a.by), "box": ensemble.box_stats(by_month, a.variable, a.by), "heatmap": ensemble.heatmap(by_month, a.variable), "heatmaps": ensemble.heatmaps(by_month, a.variable, tuple(a.scenarios), tuple(a.climate_models)), "series": ensemble.grouped_series(yearly, a.variable), "variance": ensemble.variance_decomposition(yearly, a.variable)}
        write_results(results, a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
