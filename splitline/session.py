"""What a session needs: the package on its workers, and a folder that all machines share."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors, once per Spark context, so that workers import it wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_splitline_shipped", False):
        home = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="splitline-")) / "splitline.zip"
        with zipfile.ZipFile(path, "w") as z:
            for source in sorted(home.rglob("*.py")):
                z.write(source, source.relative_to(home.parent))
        context.addPyFile(str(path))
        context._splitline_shipped = True
        if context.master.startswith("local"):
            shared_dir(spark)  # so that checkpoint() has a folder in tests too
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset on one machine, as in tests, a temporary one is made and set for
    checkpoint(); on a cluster that would not be shared, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(context, "_splitline_shared", None)
        if base is None:
            base = context._splitline_shared = f"file://{tempfile.mkdtemp(prefix='splitline-')}"
            context.setCheckpointDir(base)
    return base.rstrip("/")
