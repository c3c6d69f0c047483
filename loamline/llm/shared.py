"""Written tables in the folder that all executors share."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loamline.session import shared_folder


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and outlives any executor.

    Each call takes a folder of its own under the application's id, or replaces the table at ``path``, which ``df`` must not
    read; remove the application's folder when it is over.
    """
    spark = df.sparkSession
    path = path or new_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator that are emptied once nothing reads them any more, so that their disk does not wait for the
    application's end."""

    def __init__(self):
        self.paths: dict[DataFrame, str] = {}

    def stored(self, df: DataFrame) -> DataFrame:
        path = new_folder(df.sparkSession)
        out = stored(df, path)
        self.paths[out] = path
        return out

    def emptied(self, *tables: DataFrame) -> None:
        """The given tables, or all, lose their rows; no plan that is still to run may read them."""
        for table in tables or list(self.paths):
            table.sparkSession.range(0).write.mode("overwrite").parquet(self.paths.pop(table))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands Python at most 1000 rows or 8 MB at a time, so that a worker's memory is
    bounded by its batch, or by one text where that is longer."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def listed(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """``rows`` of the driver as a table. From Arrow they stand in the plan; from Python rows, executors would start Python
    workers of another kind to read them and keep these beside the others."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, row)) for row in rows], schema=schema))
