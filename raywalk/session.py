"""Session helpers: a local session, and shipping this package to executors that lack it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine with as many shuffle partitions as cores."""
    n = os.cpu_count() if cores == "*" else cores
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make Python workers able to import this package: nothing to do where they start in, or have a
    search path to, the folder that holds it; elsewhere the package goes along as a zip file."""
    home = str(ROOT.parent)
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home in paths or os.path.realpath(os.getcwd()) == home:
        return
    sc = spark.sparkContext
    if any(f"/{ROOT.name}-package.zip" in f for f in sc.listFiles):
        return
    path = Path(tempfile.mkdtemp()) / f"{ROOT.name}-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(path))
