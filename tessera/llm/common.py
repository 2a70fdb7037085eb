"""What the corpus operators share: tables cut from their lineage, broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bytes that an operator of this package broadcasts.
BROADCAST_BYTES = 32 << 20
#: The most bytes of texts that go to a Python worker at a time.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "64MB", "4MB")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Saved:
    """A DataFrame written as a table in the shared folder: it outlives lost executors and is computed once."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the table once nothing reads it any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def private(df: DataFrame) -> list[str]:
    """Columns that begin with an underscore: the operators keep such names for themselves."""
    return [c for c in df.columns if c.startswith("_")]


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` marked for broadcast if `rows` counted rows fit the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def lean_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to a few megabytes where the user left Spark's default: 10,000 rows of long texts are a burden to the JVM and to Python."""
    key, default, ours = BATCH
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if size(spark.conf.get(key)) == size(default):
        spark.conf.set(key, ours)
