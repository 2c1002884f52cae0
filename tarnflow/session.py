"""Sessions, and making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def build_session(app: str = "tarnflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; sizes are left to the cluster's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path that driver and executors share: below spark.checkpoint.dir, or a temporary one of a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tarnflow-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send the package's code to Python workers, unless their path has it already."""
    sc = spark.sparkContext
    paths = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.master.startswith("local"):
        paths.append(Path.cwd())
    if _ROOT in paths or sc.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="tarnflow-code-")) / "tarnflow.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((_ROOT / "tarnflow").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
