"""Reading tables and cutting lineage, shared by the operators of this package."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


#: Most bytes that Spark hands to Python at once, so that many long rows do not meet in a task's memory.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES, unless the session states a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local master may leave it unset, and gets a private one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tessera-"))
    return f"file://{_local[0]}"


class Scratch:
    """Written intermediate tables of one job. They outlive lost executors; drop() frees a superseded one.

    A result reads its tables whenever it is used, so what is left of them is deleted by close(), or when the driver ends.
    """

    _kept: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.made = 0
        Scratch._kept.append(self)

    def cut(self, df: DataFrame, row_group: int | None = None) -> DataFrame:
        """df written and read again; row_group bounds the bytes of Parquet row groups where rows are large."""
        path = f"{self.base}/{self.made}"
        self.made += 1
        (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def numbered(self, df: DataFrame) -> tuple[DataFrame, str]:
        """df written with a number of its own for each row, and the name of that column."""
        name = "_row"
        while name.lower() in (c.lower() for c in df.columns):
            name += "_"
        return self.cut(df.withColumn(name, F.monotonically_increasing_id())), name

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files of tables that no later step reads."""
        for path in {f.rpartition("/")[0] for frame in frames for f in frame.inputFiles()}:
            self._delete(path)

    def close(self) -> None:
        """Delete all that is left."""
        if self.made:
            self._delete(self.base)
            self.made = 0

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _close_all() -> None:
    for scratch in Scratch._kept:
        try:
            scratch.close()
        except Exception:  # noqa: BLE001  the session is gone
            return
