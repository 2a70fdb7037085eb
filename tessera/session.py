"""Session defaults shared by tests, the bench and stand-alone runs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "6g", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session. On a cluster the submitter sets these; operators never do."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera").config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a context; needed where it isn't installed on them."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    here = Path(__file__).parent
    with zipfile.ZipFile(Path(tempfile.mkdtemp(prefix="spark-")) / "tessera.zip", "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent))
    context.addPyFile(out.filename)
    context._tessera_shipped = True
