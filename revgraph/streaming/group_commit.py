"""Group commit: files that land between two triggers form one consolidated batch with one shared report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revgraph.model import LAYOUTS
from revgraph.plans.merge import merge_files
from revgraph.sources.batch import ABSENT, WIDTH, fields_of_columns, result_of_record
from revgraph.sources.store import Store


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of file and c0..c7 over the CSV files of a folder."""
    return spark.readStream.schema(", ".join(f"c{i} string" for i in range(WIDTH))).option("nullValue", ABSENT).option("multiLine", True).option("escape", "\\").csv(folder).withColumn("file", F.col("_metadata.file_path"))


def run(store: Store, folder: str, checkpoint: str, report: Callable[[DataFrame, int], None] | None = None, available_now: bool = True):
    """Merge every group of new files into the store's open revision; one writer, groups in order.

    Files are merged from the paths of the group, so their records keep their order; the report goes to all of them.
    """

    def commit(batch: DataFrame, epoch: int) -> None:
        files = sorted(r[0] for r in batch.select("file").distinct().collect())  # the group's file names
        if files:
            made = merge_files(store, files).withColumn("files", F.array(*map(F.lit, files)))
            if report:
                report(made, epoch)

    writer = stream_records(store.spark, folder).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def counts_by_kind(spark: SparkSession, folder: str, checkpoint: str, name: str) -> DataFrame:
    """Records of each kind in all files of a folder, through one available-now stream into memory."""
    q = stream_records(spark, folder).where(F.col("c0").isin(*LAYOUTS)).groupBy(F.col("c0").alias("kind")).count().writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def counts_by_result(spark: SparkSession, folder: str, checkpoint: str, name: str) -> DataFrame:
    """All records of all files of a folder by kind and result, through one available-now stream into memory."""
    rows = stream_records(spark, folder).select(fields_of_columns().alias("fields")).withColumn("kind", F.element_at("fields", 1))
    q = rows.groupBy("kind", result_of_record().alias("result")).agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
