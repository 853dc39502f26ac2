"""Session construction and the few settings that operators read from a session."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build_session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow on; `conf` overrides any of it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one is set only where there is none.

    On a cluster `spark.checkpoint.dir` names a folder that all executors share, and it is left as it is.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="weftline-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably and drop its lineage (iterative operators call it once a round)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per context.

    Nothing happens where the repository is on PYTHONPATH, as workers inherit that.
    """
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_weftline_shipped", False):
        return
    # beside the checkpoints where those are in a file system, so that nothing depends on a folder of one machine
    shared = ensure_checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
    folder = Path(shared) if shared.startswith("/") else Path(tempfile.mkdtemp(prefix="weftline-package-"))
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / "weftline_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted((ROOT / "weftline").rglob("*.py")):
            archive.write(path, path.relative_to(ROOT))
    before = list(sys.path)
    context.addPyFile(str(target))
    sys.path[:] = before  # the driver keeps importing from the checkout
    context._weftline_shipped = True
