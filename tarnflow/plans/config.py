"""Settings of a run: defaults, a YAML file over them, paths with variables."""

from __future__ import annotations

import logging
import os
import re
from dataclasses import dataclass, fields, replace
from pathlib import Path

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class RunConfig:
    variable: str = "qtot"
    hydro_model: str = "CWatM"
    climate_model: str = "gfdl-esm4"
    scenario: str = "ssp126"
    data_period: str = "historical"
    region: str = "R12"
    temporal_resolution: str = "monthly"
    spatial_method: str = "sum"
    input_dir: str = "./input"
    area_file: str = ""
    basin_shapefile: str = ""
    output_dir: str = "./hydro_output"
    test_file: str = ""


def expand_path(path: str) -> str:
    """${VAR} and ~ replaced, then normalised; an unset variable is logged and counts as empty."""

    def value(m: re.Match) -> str:
        name = m[1]
        if name not in os.environ:
            log.warning("environment variable %s is not set", name)
        return os.environ.get(name, "")

    return os.path.normpath(os.path.expanduser(re.sub(r"\$\{(\w+)\}", value, path))) if path else path


def load_config(base: RunConfig, path: str = "") -> RunConfig:
    """base with the file's keys over it (unknown keys are an error), and paths expanded."""
    if path:
        import yaml

        data = yaml.safe_load(Path(path).read_text()) or {}
        unknown = set(data) - {f.name for f in fields(RunConfig)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        base = replace(base, **{k: str(v) for k, v in data.items()})
    return replace(base, **{k: expand_path(getattr(base, k)) for k in ("input_dir", "area_file", "basin_shapefile", "output_dir", "test_file")})
