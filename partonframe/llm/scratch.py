"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import delete, new_folder

#: Bytes of text that a Python worker gets at a time, but for a single longer text.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; by records alone, a batch of long documents would outgrow a worker's memory.

    A session setting, since Spark has none for a single operator; a lower bound that the session has is kept.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


class Scratch:
    """Parquet tables that cut lineage: a lost executor costs a reread, never a recomputation of what was written.

    Results built on a scratch table stay lazy, so the caller decides when to :meth:`close`; what nobody
    closes is deleted by ``partonframe.shared.sweep``, at the latest when Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, 0
        self.root = new_folder(spark, "scratch")

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.tables}"
        self.tables += 1
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        delete(self.spark, df._scratch_path)

    def close(self) -> None:
        delete(self.spark, self.root)
